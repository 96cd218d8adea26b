"""Scoring a search's rows: one row from Python per row, features by entries, and constants of means taken once."""

import numpy as np
from pyspark.sql import functions as F

from ionforge.operators import models, trees
from ionforge.session import stored

WIDTH, FOLDS, N = 4, 3, 60


def test_keys_are_sent_back_once_for_all_models(spark):
    """Python gives one row per row, whatever number of models scores it."""
    data = [(f"u{i}", i % FOLDS, [i % WIDTH], [1.0 + i]) for i in range(N)]
    rows = stored(spark.createDataFrame(data, "row_uid string, fold int, idx array<int>, val array<double>"), "scored")
    constant = lambda v: trees.Ensemble(v, trees.TreeSettings(), np.zeros(WIDTH), np.ones(WIDTH))
    own = {s: [("a", constant(1.0)), ("b", constant(2.0))][: 1 + (s != 1)] for s in range(2)}
    scored = models.predict_models(rows.withColumn("scope", F.col("fold")), own, ["row_uid", "fold"], WIDTH)
    assert "Generate" in scored._jdf.queryExecution().executedPlan().toString()
    found = {(r.fold, r.candidate, r.prediction): r["count"] for r in scored.groupBy("fold", "candidate", "prediction").count().collect()}
    sizes = [sum(i % FOLDS == f for i in range(N)) for f in range(FOLDS)]
    assert found == {(0, "a", 1.0): sizes[0], (0, "b", 2.0): sizes[0], (1, "a", 1.0): sizes[1]}


def test_scaled_cosines_are_those_of_numpy(rng):
    turns = rng.uniform(-50, 50, (300, 70))
    want = 0.125 * np.cos(2 * np.pi * turns)
    models.cosines(turns, 0.125)
    assert np.abs(turns - want).max() < 1e-13


def test_models_that_are_no_kernels_read_the_same_rows(rng):
    x = rng.normal(size=(50, WIDTH)) * (rng.random((50, WIDTH)) < 0.5)
    made = models.Entries.of(x)
    assert (made.dense(WIDTH) == x).all()
    e = trees.Ensemble(1.0, trees.TreeSettings(1, 1, 4), np.full(WIDTH, -2.0), np.ones(WIDTH), [np.array([1, -1, -1])], [np.array([1, 0, 0])], [np.array([0.0, 5.0, 7.0])])
    (cid, p), = models.predict_block(made, [("t", e)], WIDTH)
    assert cid == "t" and np.allclose(p, 1 + 0.3 * np.where(np.clip(np.floor(x[:, 1] + 2), 0, 3) > 1, 7.0, 5.0))
