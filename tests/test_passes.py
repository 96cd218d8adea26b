"""What passes over stored rows cost: how many there are, and that they give what a plain version gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionforge.operators import models, preprocess, search, trees
from ionforge.plans import fixtures
from ionforge.session import TASK_ROWS, scratch_path, stored

WIDTH, FOLDS, N = 12, 3, 300


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(N, WIDTH)) * (rng.random((N, WIDTH)) < np.linspace(0.02, 1, WIDTH))
    x[:, 4] += 500.0  # a mean far above its deviation
    y = 1 + np.sin(x[:, 8]) + 0.3 * x[:, 9] + 0.1 * rng.normal(size=N)
    fold, ion = np.arange(N) % FOLDS, np.where(np.arange(N) % 2, "Li", "Mg")
    rows = [(f"u{i}", f"g{i}", str(ion[i]), int(fold[i]), float(y[i]), [int(j) for j in np.flatnonzero(x[i])], [float(v) for v in x[i][x[i] != 0]]) for i in range(N)]
    df = stored(spark.createDataFrame(rows, "row_uid string, group_id string, ion string, fold int, y double, idx array<int>, val array<double>"), "passes")
    states = stored(preprocess.fit_states(df, WIDTH, FOLDS), "st")
    maps = models.RandomFeatures(states, stored(preprocess.fit_pca(df, states, WIDTH, 3), "pc"), None, 24, 1, WIDTH)
    return x, y, fold, ion, df, maps


def test_features_by_entries_are_those_of_dense_rows(table):
    x, _, _, _, _, maps = table
    for scope in (0, -1):
        idx, mean, std = maps.scaler[scope]
        z = (x[:, idx] - mean) / std
        for rep, own in (("scaled", z), ("pca", z @ maps.pca[scope][0])):
            w = np.random.default_rng([1, own.shape[1]]).standard_normal((own.shape[1], 24))
            b = np.random.default_rng([1, own.shape[1], 1]).uniform(0, 2 * np.pi, 24)
            want = np.sqrt(2 / 24) * np.cos(np.sqrt(0.2) * (own @ w) + b)
            assert np.abs(maps.features(models.Entries.of(x), scope, rep, 0.1) - want).max() < 1e-11


def test_a_first_fit_of_some_rows_changes_no_minimum(table, monkeypatch):
    df, maps = table[-2:]
    grid = [c for c in models.candidates() if c["family"] == "svr"]
    passes, real = [], models.array_sums
    monkeypatch.setattr(models, "array_sums", lambda rows, *rest: passes.append(rows is df) or real(rows, *rest))
    plain = models.rbf_eps_regression(df, maps, grid, FOLDS, [0, -1])
    whole = sum(passes)
    passes.clear()
    near = models.rbf_eps_regression(df, maps, grid, FOLDS, [0, -1], first=N // 4)
    assert 0 < sum(passes) <= whole and len(passes) > sum(passes)
    for a, b in zip(plain, near):
        assert a[:5] == b[:5] and np.abs(a[5] - b[5]).max() < 1e-6


def test_trees_of_all_populations_share_their_passes(spark, table, monkeypatch):
    grid = [dict(c, parameters={"trees": 2, "depth": 2}) for c in models.candidates() if c["family"] == "tree"]
    found = search.Search(table[-2], {"mixed_ions": None, "li_only": ["Li"]}, FOLDS, WIDTH, scratch_path(spark, "search"), grid, components=3, size=8)
    levels, real = [], trees.level_sums
    monkeypatch.setattr(trees, "level_sums", lambda *a: levels.append(1) or real(*a))
    assert found.run() == 12 and len(levels) <= 4
    assert {(r.missing_rows, r.repeated_rows) for r in found.summary().collect()} == {(0, 0)}


def test_rows_of_one_row_group_are_dealt_over_all_tasks(spark, tmp_path):
    """Splits of a large file without the start of a row group are empty, so the number of splits says nothing."""
    n = 4 * TASK_ROWS
    df = spark.range(n).select(F.col("id").alias("o_orderkey"), (F.col("id") % 99).alias("o_custkey"), F.lit(1.5).alias("o_totalprice"))
    df.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        sizes = [r["n"] for r in fixtures.rx(spark, str(tmp_path)).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(sizes) == n and max(sizes) < 1.1 * TASK_ROWS
