import numpy as np
import pytest
from pyspark.sql import functions as F

from ionforge.operators import evaluate, models, preprocess, search, trees
from ionforge.operators.preprocess import ALL
from ionforge.session import scratch_path, stored

WIDTH, FOLDS, N = 8, 3, 240


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(N, WIDTH)) * (rng.random((N, WIDTH)) < 0.7)
    x[:, 2], x[:, 6] = 4.0, 0.0
    x[:, 5] = rng.integers(0, 2, N)
    y = 2 + 1.5 * np.sign(x[:, 0]) * x[:, 5] + 0.5 * x[:, 3] + 0.05 * rng.normal(size=N)
    fold, ion = np.arange(N) % FOLDS, np.where(np.arange(N) % 2, "Li", "Mg")
    rows = [(f"u{i:03d}", f"g{i}", str(ion[i]), int(fold[i]), float(y[i]), [int(j) for j in np.flatnonzero(x[i])], [float(v) for v in x[i][x[i] != 0]]) for i in range(N)]
    df = spark.createDataFrame(rows, "row_uid string, group_id string, ion string, fold int, y double, idx array<int>, val array<double>")
    return x, y, fold, ion, stored(df.repartition(5), "world")


def direct_tree(x, r, e, settings, depth=0):
    """Predictions of a tree grown by trying every column and bin over plain arrays."""
    out = np.full(len(x), r.mean())
    if depth == settings.depth:
        return out
    best, at = settings.min_gain * len(x), None
    for j in range(WIDTH):
        bins = e.bins_of(x[:, j], np.full(len(x), j))
        for b in range(settings.bins - 1):
            left = bins <= b
            n, m = left.sum(), (~left).sum()
            if min(n, m) >= settings.min_rows:
                gain = r[left].sum() ** 2 / n + r[~left].sum() ** 2 / m - r.sum() ** 2 / len(r)
                if gain > best + 1e-12:
                    best, at = gain, left
    if at is not None:
        out[at], out[~at] = direct_tree(x[at], r[at], e, settings, depth + 1), direct_tree(x[~at], r[~at], e, settings, depth + 1)
    return out


def test_all_scopes_grow_as_each_would_alone(world):
    x, y, fold, ion, df = world
    grid = {"a": trees.TreeSettings(trees=4, depth=3, bins=8), "b": trees.TreeSettings(trees=2, depth=1, bins=8)}
    populations = {"mixed": None, "li": ["Li"]}
    tasks = [(g, p, f) for g in grid for p in populations for f in (0, 1, 2, ALL)]
    fitted = trees.fit(df, WIDTH, populations, grid, tasks)
    for (name, population, held), e in fitted.items():
        train = (fold != held) & ((ion == "Li") | (population == "mixed"))
        assert np.allclose(e.low, x[train].min(0)) and len(e.value) == grid[name].trees
        guess = np.full(train.sum(), y[train].mean())
        for _ in range(grid[name].trees):
            guess += e.settings.rate * direct_tree(x[train], y[train] - guess, e, grid[name])
        assert np.abs(e.predict(x[train]) - guess).max() < 1e-9


def test_rows_outside_a_scope_change_nothing(world):
    x, y, fold, ion, df = world
    moved = stored(df.withColumns({"y": F.when(F.col("fold") == 1, F.col("y") * 9).otherwise(F.col("y")), "val": F.when(F.col("fold") == 1, F.transform("val", lambda v: v - 7)).otherwise(F.col("val"))}), "moved")
    grid, tasks = {"a": trees.TreeSettings(trees=3, depth=2)}, [("a", "mixed", 1)]
    a, b = (trees.fit(d, WIDTH, {"mixed": None}, grid, tasks)["a", "mixed", 1] for d in (df, moved))
    assert np.allclose(a.predict(x), b.predict(x))


def test_a_scope_without_rows_is_an_error(world):
    with pytest.raises(ValueError, match="no training rows"):
        trees.fit(world[-1], WIDTH, {"none": ["Xx"]}, {"a": trees.TreeSettings()}, [("a", "none", 0)])


@pytest.fixture(scope="module")
def maps(world):
    df = world[-1]
    states = stored(preprocess.fit_states(df, WIDTH, FOLDS), "st")
    return models.RandomFeatures(states, stored(preprocess.fit_pca(df, states, WIDTH, 3), "pc"), None, 24, 1, WIDTH)


def objective(w, phi, t, c, epsilon):
    return 0.5 * w @ w + c * (np.maximum(np.abs(t - phi @ w) - epsilon, 0) ** 2).sum()


def direct_minimum(phi, t, c, epsilon, steps=20_000):
    """Accelerated gradient descent, an algorithm other than the library's."""
    size = 1 / (1 + 2 * c * np.linalg.norm(phi, 2) ** 2)
    w = ahead = np.zeros(phi.shape[1])
    for k in range(steps):
        r = t - phi @ ahead
        out = np.sign(r) * np.maximum(np.abs(r) - epsilon, 0)
        new = ahead - size * (ahead - 2 * c * phi.T @ out)
        ahead, w = new + k / (k + 3) * (new - w), new
    return w


def test_epsilon_regression_settles_at_the_direct_minimum(world, maps):
    x, y, fold, ion, df = world
    grid = [c for c in models.candidates() if c["family"] == "svr"]
    fitted = models.rbf_eps_regression(df, maps, grid, FOLDS, [0, 2, ALL])
    assert len(fitted) == len(grid) * 3 == 18
    for cid, scope, rep, gamma, offset, w in fitted:
        p = next(c for c in grid if c["id"] == cid)["parameters"]
        phi, t = maps.features(x[fold != scope], scope, rep, gamma), y[fold != scope] - offset
        at = objective(w, phi, t, p["C"], p["epsilon"])
        r = t - phi @ w
        slope = w - 2 * p["C"] * phi.T @ (np.sign(r) * np.maximum(np.abs(r) - p["epsilon"], 0))
        assert np.abs(slope).max() < 1e-6 * max(1, np.abs(w).max())
        if scope == 0:
            assert at <= objective(direct_minimum(phi, t, p["C"], p["epsilon"]), phi, t, p["C"], p["epsilon"]) * (1 + 1e-6)


def test_a_fit_that_has_not_settled_is_an_error(world, maps):
    with pytest.raises(models.NotConverged, match="svr_scaled_2"):
        models.rbf_eps_regression(world[-1], maps, [c for c in models.candidates() if c["id"] == "svr_scaled_2"], FOLDS, [0], most_passes=2)


@pytest.fixture(scope="module")
def found(spark, world):
    s = search.Search(world[-1], {"mixed_ions": None, "li_only": ["Li"]}, FOLDS, WIDTH, scratch_path(spark, "search"), components=3, size=24)
    s.first = s.run()
    return s


def test_search_runs_once_and_covers_every_row(found):
    assert found.first == 14 * 3 * 2 and found.run() == 0
    summary = found.summary().collect()
    assert len(summary) == 28 and {(r.missing_rows, r.repeated_rows, r.folds) for r in summary} == {(0, 0, 3)}
    chosen = {(r.population, r.family): r for r in found.select(found.summary()).collect()}
    for (population, family), r in chosen.items():
        own = sorted((s.mean_mae, s.candidate) for s in summary if (s.population, s.family) == (population, family))
        assert (r.mean_mae, r.candidate) == own[0]
        assert r.selected == (r.candidate == min((s.mean_mae, s.candidate) for s in summary if s.population == population)[1])
    tree = next(r for r in summary if (r.population, r.candidate) == ("mixed_ions", "tree_raw_0"))
    assert tree.mae < 0.7 * evaluate.regression_metrics(evaluate.median_oof(found.rows, FOLDS)).first()["mae"]


def test_search_reopens_only_what_changed(spark, found, world):
    df = world[-1]
    other = found.over(stored(df.where("row_uid <> 'u001'"), "less"))  # Li, fold 1
    assert {(r.population, r.fold) for r in other.pending().collect()} == {(p, f) for p in found.populations for f in (0, 2)}
    grid = [dict(c, parameters=dict(c["parameters"], alpha=0.5)) if c["id"] == "krr_pca_1" else c for c in models.candidates()]
    tuned = search.Search(df, found.populations, FOLDS, WIDTH, found.path, grid, components=3, size=24)
    assert {r.candidate for r in tuned.pending().collect()} == {"krr_pca_1"} and tuned.run() == 6
    assert {(r.missing_rows, r.repeated_rows) for r in tuned.summary().collect()} == {(0, 0)}
    assert found.run() == 0 and {(r.missing_rows, r.repeated_rows) for r in found.summary().collect()} == {(0, 0)}


def test_an_interrupted_batch_is_repeated_without_doubling(spark, found, world, monkeypatch):
    s = search.Search(world[-1], {"mixed_ions": None}, FOLDS, WIDTH, scratch_path(spark, "search"), [c for c in models.candidates() if c["family"] == "krr"][:2], components=3, size=8)
    create = spark.createDataFrame

    def broken(*args, **kwargs):
        if "digest string" in str(args[1:]) and "batch" not in str(args[1:]):
            raise OSError("lost")
        return create(*args, **kwargs)

    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, *a, **k: broken(*a, **k))
    with pytest.raises(OSError):
        s.run()  # the rows are written, their tasks aren't
    monkeypatch.undo()
    assert s.run() == 6
    assert {(r.missing_rows, r.repeated_rows) for r in s.summary().collect()} == {(0, 0)}


def test_evaluation_after_the_choice_is_frozen(found, world):
    x, y, fold, ion, df = world
    held = df.withColumns({"role": F.when(F.col("ion") == "Li", "holdout").otherwise("held_out_Na"), "group_id": F.concat(F.lit("new"), "group_id")})
    selection, scored, metrics = found.evaluate(held)
    assert selection.count() == 6 and scored.count() == 6 * N
    got = {(r.population, r.family, r.role, r.subgroup): r for r in metrics.collect()}
    assert got["mixed_ions", "tree", "holdout", "all"].n == (ion == "Li").sum() and got["li_only", "krr", "held_out_Na", "known_group"].n == 0
    with pytest.raises(Exception, match="share a group"):
        found.evaluate(df.withColumn("role", F.lit("holdout")))[2].collect()
