import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ionforge.constants import SplitSettings
from ionforge.operators import components, ranking, skew, splits


def brute_groups(rows):
    """Components by repeated merging of token sets."""
    parts = []
    for uid, *tokens in rows:
        keys = {(i > 0, t) for i, t in enumerate(tokens) if t}
        hit = [p for p in parts if p[1] & keys]
        merged = ({uid}, keys)
        for p in hit:
            merged = (merged[0] | p[0], merged[1] | p[1])
            parts.remove(p)
        parts.append(merged)
    return {u: "g_" + min(uids) for uids, _ in parts for u in uids}


def random_rows(n, seed):
    r = random.Random(seed)
    pick = lambda k: "" if r.random() < 0.15 else f"t{r.randrange(k)}"
    return [(f"u{i:04d}", pick(n), pick(n), "" if r.random() < 0.3 else pick(n)) for i in range(n)]


KINDS = [("a", "a"), ("b", "b"), ("b", "c")]


def test_components_of_a_single_kind(spark):
    df = spark.createDataFrame([("u1", "x"), ("u2", "x"), ("u3", ""), ("u4", "y")], "uid string, a string")
    got = {r.uid: r.group_id for r in components.connected_groups(df, "uid", [("a", "a")]).collect()}
    assert got == {"u1": "g_u1", "u2": "g_u1", "u3": "g_u3", "u4": "g_u4"}


@pytest.mark.parametrize("per_task", [4, 1000])
def test_components_match_brute_force(spark, monkeypatch, per_task):
    monkeypatch.setattr(skew, "HOT_PER_TASK", per_task)
    rows = random_rows(150, 3) + [(f"h{i:03d}", "hub", f"leaf{i}", "") for i in range(60)] + [(f"c{i:03d}", f"p{i}", f"q{i}", f"q{i + 1}") for i in range(40)]
    df = spark.createDataFrame(rows, "uid string, a string, b string, c string").repartition(5)
    got = {r.uid: r.group_id for r in components.connected_groups(df, "uid", KINDS).collect()}
    assert got == brute_groups(rows)


def greedy(sizes, k):
    totals, counts, out = [0] * k, [0] * k, []
    for s in sizes:
        f = min(range(k), key=lambda i: (totals[i], counts[i], i))
        totals[f] += s
        counts[f] += 1
        out.append(f)
    return out


def test_fill_plan_equals_literal_greedy():
    r = random.Random(5)
    for trial in range(300):
        k = r.randrange(2, 8)
        sizes = sorted((r.choice([1, 1, 1, 2, 3, 5, 8, r.randrange(1, 400)]) for _ in range(r.randrange(1, 120))), reverse=True)
        plan = splits.fill_plan([(s, sizes.count(s)) for s in set(sizes)], k)
        got = []
        for s in sorted(plan, reverse=True):
            for rank in range(sizes.count(s)):
                start, turn = [seg for seg in plan[s] if seg[0] <= rank][-1]
                got.append(turn[(rank - start) % len(turn)])
        assert got == greedy(sizes, k)


def test_fill_plan_stays_small_for_a_dominant_group():
    plan = splits.fill_plan([(10 ** 9, 1), (1, 2 * 10 ** 9)], 10)
    assert sum(len(s) for s in plan.values()) <= 20


def test_folds_and_holdout_match_definition(spark):
    groups = [f"g{i}" for i in range(57)]
    rows = [(g,) for i, g in enumerate(groups) for _ in range(1 + (i * i) % 7)]
    settings = SplitSettings(cv_folds=4)
    df = spark.createDataFrame(rows, "group_id string")
    sizes = {g: 1 + (i * i) % 7 for i, g in enumerate(groups)}
    digest = lambda salt, g: hashlib.sha256(f'[42,"{salt}","{g}"]'.encode()).hexdigest()
    order = sorted(groups, key=lambda g: (-sizes[g], digest("cv", g)))
    want = dict(zip(order, greedy([sizes[g] for g in order], 4)))
    assert {r.group_id: r.fold for r in splits.balanced_group_folds(df, "cv", settings).collect()} == want
    held = {r.group_id for r in splits.hash_holdout(df).where("held").collect()}
    assert held == set(sorted(groups, key=lambda g: digest("holdout", g))[:6])
    with pytest.raises(ValueError):
        splits.balanced_group_folds(df.where("group_id IN ('g1', 'g2')"), "cv", settings)
    with pytest.raises(Exception, match="not enough groups"):
        splits.hash_holdout(df.where("group_id = 'g1'")).collect()


def test_settings_are_checked():
    for bad in ({"seed": True}, {"holdout_fraction": 1.0}, {"cv_folds": 1}, {"review_low": 11.0}, {"label_tolerance": 0.5}):
        with pytest.raises(ValueError):
            SplitSettings(**bad)


def test_attach_is_whole_with_hot_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_PER_TASK", 100)
    rows = [(i, "hot" if i % 3 else (f"k{i % 7}" if i % 2 else None)) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, k string")
    stats = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("m")).where("k IS NOT NULL")
    got = {r.i: r.m for r in skew.attach(df, stats, ["k"], ["m"], ["i"]).collect()}
    top = {}
    for i, k in rows:
        top[k] = max(top.get(k, -1), i)
    assert got == {i: (None if k is None else top[k]) for i, k in rows}
    dim = spark.createDataFrame([("hot", 1), ("k1", 2)], "k string, v int")
    looked = {r.i: r.v for r in skew.lookup(df, dim, ["k"], ["v"], ["i"]).collect()}
    assert looked == {i: {"hot": 1, "k1": 2}.get(k) for i, k in rows}


def test_exact_median(spark, rng):
    import numpy as np
    values = np.concatenate([rng.normal(size=501), [0.25] * 400, [1e9]])
    rows = [(int(i % 2), float(v)) for i, v in enumerate(values)] + [(3, 7.0), (4, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: r.median for r in ranking.exact_median(df, ["g"], "v").collect()}
    for g in (0, 1):
        assert got[g] == pytest.approx(np.median([v for i, v in rows if i == g]))
    assert got[3] == 7.0 and 4 not in got
    assert ranking.exact_median(df, [], "v").first()["median"] == pytest.approx(np.median([v for _, v in rows if v is not None]))


def test_audit_finds_a_leak(spark):
    rows = [(f"g{i}", f"r{i}", f"a{i}", "shared" if i in (0, 5) else f"b{i}", f"h{i}", "development", i % 2) for i in range(6)]
    df = spark.createDataFrame(rows, "group_id string, record_key string, id_charge string, id_discharge string, canonical_host string, partition string, fold int")
    audit = splits.cv_leakage_audit(df, "fold", "x", SplitSettings(cv_folds=2))
    assert {(r.fold, r.shared_endpoint, r.shared_group) for r in audit.collect()} == {(0, 1, 0), (1, 1, 0)}
    with pytest.raises(Exception, match="leakage"):
        splits.assert_no_leakage(audit).collect()


@pytest.mark.parametrize("chunk,tasks,most", [(40, 20, 12), (1_000_000, 1, 1)])
def test_chains_and_hubs_settle_in_few_rounds(spark, monkeypatch, chunk, tasks, most):
    monkeypatch.setattr(components, "CHUNK", chunk)
    edges = [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(2000)] + [("hub", f"h{i}") for i in range(1500)] + [("x", "x")]
    random.Random(2).shuffle(edges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(tasks == 1).lower())
    try:
        found, rounds = components.token_components(spark.createDataFrame(edges, "u string, v string").repartition(tasks))
        rows = [(r.token, r.rep) for r in found.collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert rounds <= most and len(rows) == len(dict(rows)) == 2000 + 1500
    assert len({rep for token, rep in rows if token[0] == "c"}) == len({rep for token, rep in rows if token[0] != "c"}) == 1


def test_a_hub_meets_one_row_per_task(spark):
    edges = spark.range(20_000).select(F.lit("hub").alias("u"), F.concat(F.lit("h"), "id").alias("v")).repartition(6)
    stars = components.local_stars(edges, 0)
    assert stars.where("x = 'hub'").count() <= 6 and stars.count() <= 20_000 + 6


def test_exact_median_per_scope_with_an_outlier(spark, rng):
    import numpy as np
    values = np.concatenate([rng.normal(size=4001), [1e9, -1e300, 5.0, 5.0]])
    rows = [(int(i % 4), float(v)) for i, v in enumerate(values)] + [(1, None)]
    df = spark.createDataFrame(rows, "fold int, v double").repartition(5)
    others = F.filter(F.array(*[F.lit(s) for s in (0, 1, 2, 3, -1)]), lambda s: s != F.col("fold"))
    got = {r.scope: r.median for r in ranking.exact_median(df, [], "v", fold="fold", scopes=("scope", others)).collect()}
    for scope in (0, 1, 2, 3, -1):
        assert got[scope] == np.median([v for f, v in rows if f != scope and v is not None])


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_ranks_through_levels_of_buckets(spark, monkeypatch, levels):
    monkeypatch.setattr(ranking, "LEVEL_DIGITS", 1)
    rows = [(c, hashlib.sha256(f"{c}{i}".encode()).hexdigest()) for c in "ab" for i in range(400)]
    got = {(r.c, r.h): r["rank"] for r in ranking.hash_rank(spark.createDataFrame(rows, "c string, h string"), "h", within=["c"], levels=levels).collect()}
    want = {(c, h): i for c in "ab" for i, h in enumerate(sorted(h for k, h in rows if k == c))}
    assert got == want
    assert ranking.bucket_levels(10) == 1 and ranking.bucket_levels(10**9) > 1


def test_plan_of_a_class_table_equals_the_list(spark):
    r = random.Random(1)
    classes = [(s, r.randrange(1, 50)) for s in r.sample(range(1, 4000), 1500)]
    table = splits.filled(spark.createDataFrame(classes, "__size long, n long").repartition(7), 6).collect()
    assert {t["__size"]: [(s.start, s.turn) for s in t["__plan"]] for t in table} == splits.fill_plan(classes, 6)
