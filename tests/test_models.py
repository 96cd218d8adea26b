import numpy as np
import pytest
from pyspark.sql import functions as F

from ionforge.operators import evaluate, features, models, preprocess, profiles, scoring
from ionforge.session import stored

WIDTH, FOLDS = 9, 3


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, WIDTH)) * (rng.random((90, WIDTH)) < 0.6)
    x[:, 3] = 2.5                       # constant
    x[:, 5] = 0.0
    x[:, 7] += 1000.0                   # large offset
    y = 2 + 0.3 * x[:, 0] - 0.1 * x[:, 1]
    fold = np.arange(90) % FOLDS
    rows = [(f"u{i:02d}", f"g{i}", int(fold[i]), float(y[i]), [int(j) for j in np.flatnonzero(x[i])], [float(v) for v in x[i][x[i] != 0]]) for i in range(90)]
    df = spark.createDataFrame(rows, "row_uid string, group_id string, fold int, y double, idx array<int>, val array<double>")
    return x, y, fold, stored(df, "matrix")


def test_states_and_pca_match_numpy(spark, matrix):
    x, y, fold, df = matrix
    states = stored(preprocess.fit_states(df, WIDTH, FOLDS), "st")
    got = {(r.scope, r.idx): r for r in states.collect()}
    pca = preprocess.fit_pca(df, states, WIDTH, 3)
    comps = {(r.scope, r.component): r for r in pca.collect()}
    for scope in (-1, 0, 1, 2):
        t = x[fold != scope]
        for j in range(WIDTH):
            r = got[scope, j]
            assert r.train_rows == len(t) and r.active == (np.ptp(t[:, j]) > 1e-12)
            assert r["mean"] == pytest.approx(t[:, j].mean(), abs=1e-9)
            if r.active:
                assert r.std == pytest.approx(t[:, j].std(), rel=1e-8)
        keep = np.ptp(t, axis=0) > 1e-12
        z = (t[:, keep] - t[:, keep].mean(0)) / t[:, keep].std(0)
        s = np.linalg.svd(z, compute_uv=False) ** 2
        assert [comps[scope, c].ratio for c in range(3)] == pytest.approx(list(s[:3] / s.sum()), rel=1e-7)
    with pytest.raises(ValueError):
        preprocess.fit_pca(df, states, WIDTH, WIDTH)


def test_validation_rows_do_not_touch_the_fit(spark, matrix):
    x, y, fold, df = matrix
    moved = df.withColumn("val", F.when(F.col("fold") == 1, F.transform("val", lambda v: v + 5)).otherwise(F.col("val")))
    pick = lambda d: {(r.idx, r.active): (r["mean"], r.std) for r in preprocess.fit_states(d, WIDTH, FOLDS).where("scope = 1").collect()}
    a, b = pick(df), pick(stored(moved, "mv"))
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-7)


def test_kernel_models_match_direct_solution(spark, matrix):
    x, y, fold, df = matrix
    states = stored(preprocess.fit_states(df, WIDTH, FOLDS), "st")
    pca = preprocess.fit_pca(df, states, WIDTH, 3)
    maps = models.RandomFeatures(states, pca, None, 16, 1, WIDTH)
    grid = [c for c in models.candidates() if c["family"] == "krr"]
    fitted = models.rbf_ridge(df, maps, grid, FOLDS, [0, 1, 2])
    for cid, scope, rep, gamma, offset, w in fitted:
        train = fold != scope
        phi = maps.features(x[train], scope, rep, gamma)
        alpha = next(c for c in grid if c["id"] == cid)["parameters"]["alpha"]
        direct = np.linalg.solve(phi.T @ phi + alpha * np.eye(16), phi.T @ (y[train] - y[train].mean()))
        assert w == pytest.approx(direct, rel=1e-5, abs=1e-6)
    scored = models.predict_kernel(df.withColumn("scope", F.col("fold")), maps, fitted, ["row_uid", "fold", "y"])
    cover = evaluate.oof_coverage(df, scored)
    assert {(r.missing_rows, r.repeated_rows) for r in cover.collect()} == {(0, 0)}
    tube = models.rbf_eps_regression(df, maps, [c for c in models.candidates() if c["id"] == "svr_scaled_1"], FOLDS, [0])
    assert np.isfinite(tube[0][-1]).all()


def test_selection_ties_and_bad_scores(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "candidate string, mean_mae double")
    assert evaluate.select_candidate(df).first()["candidate"] == "a"
    with pytest.raises(Exception, match="finite"):
        evaluate.select_candidate(df.withColumn("mean_mae", F.lit(float("nan")))).collect()


def test_metric_edges(spark):
    df = spark.createDataFrame([("one", 1.0, 2.0), ("flat", 3.0, 3.0), ("flat", 3.0, 4.0), ("empty", None, None)], "g string, y double, prediction double")
    got = {r.g: r for r in evaluate.regression_metrics(df, ["g"]).collect()}
    assert got["one"].n == 1 and got["one"].r2 is None and got["flat"].r2 is None
    assert got["empty"].n == 0 and got["empty"].mae is None
    with pytest.raises(Exception, match="finite"):
        evaluate.regression_metrics(df.withColumn("prediction", F.lit(float("inf")))).collect()


def test_frozen_selection(spark):
    df = spark.createDataFrame([("krr", "a"), ("svr", "b")], "family string, candidate string")
    digest = evaluate.freeze_selection(df, ["family", "candidate"]).first()[0]
    assert evaluate.check_frozen(df.orderBy(F.desc("family")), ["family", "candidate"], digest).first()["unchanged"]
    with pytest.raises(Exception, match="frozen"):
        evaluate.check_frozen(df.withColumn("candidate", F.lit("z")), ["family", "candidate"], digest).collect()


def test_holdout_sharing_a_group_is_an_error(spark):
    dev = spark.createDataFrame([("g1",)], "group_id string")
    held = spark.createDataFrame([("u", "g1", "Li", "holdout", 1.0, 1.0)], "row_uid string, group_id string, ion string, role string, y double, prediction double")
    with pytest.raises(Exception, match="share a group"):
        evaluate.subgroup_metrics(held, dev).collect()


EXAMPLE = dict(working_ion="Li", formula_charge="FePO4", formula_discharge="LiFePO4", crystal_system_charge="orthorhombic", spacegroup_number_charge="62",
               crystal_system_discharge="orthorhombic", spacegroup_number_discharge="62")


def test_vector_ignores_everything_outside_the_whitelist(spark):
    rows = [{**EXAMPLE, "request_id": 1, "label": 3.4, "flags": "x"}, {**EXAMPLE, "request_id": 2, "label": -9.0, "flags": ""},
            {**EXAMPLE, "request_id": 3, "formula_discharge": "Li2Fe2(PO4)2", "label": 0.0, "flags": ""},
            {**EXAMPLE, "request_id": 4, "formula_discharge": "FePO4", "label": 0.0, "flags": ""}]
    out = {r.request_id: r for r in features.assemble_features(spark.createDataFrame(rows), ["request_id"]).collect()}
    assert (out[1].idx, out[1].val) == (out[2].idx, out[2].val) == (out[3].idx, out[3].val)
    assert out[1].val[out[1].idx.index(261)] == pytest.approx(1 / 7) and features.WIDTH == 740
    assert out[4].reaction_error == "loading does not increase" and out[4].idx is None


def test_contract_refuses_unknown_columns_and_text_numbers(spark):
    df = spark.createDataFrame([{**EXAMPLE, "request_id": 1, "extra": 1}])
    with pytest.raises(ValueError, match="extra"):
        scoring.contract_check(df)
    with pytest.raises(ValueError, match="integer"):
        scoring.contract_check(df.drop("extra"))


def test_profile_rules(spark):
    row = lambda p, i, s, e, **k: dict(profile_id=p, pos=i, start=s, end=e, working_ion="Li", model_family="auto", training_population="auto", host="C:1",
                                       spacegroup_number_charge=1, spacegroup_number_discharge=1, crystal_system_charge="t", crystal_system_discharge="t", **k)
    rows = [row(1, 0, 0.0, 1 / 12), row(1, 1, 1 / 12, 1 / 6), row(2, 0, 0.0, 0.5), row(2, 1, 0.6, 0.7), row(3, 0, 0.0, 1.0)]
    got = {(r.profile_id, r.pos): r.violations for r in profiles.profile_contiguity(spark.createDataFrame(rows)).collect()}
    assert got == {(1, 0): [], (1, 1): [], (2, 0): [], (2, 1): ["gap_or_overlap"], (3, 0): ["interval_count"]}
