"""Tree passes: codes shared by all scopes, the smaller child counted only, and blocks that a reader can hold."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from ionforge.operators import trees
from ionforge.session import SMALL_GROUPS, finer, stored

WIDTH, FOLDS, N = 9, 3, 400


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(N, WIDTH)) * (rng.random((N, WIDTH)) < np.linspace(0.1, 1, WIDTH))
    x[:, 6] = -x[:, 8]  # splits of either are ties but for rounding
    y = 1 + np.sin(2 * x[:, 8]) + 0.3 * x[:, 5] * x[:, 7]
    data = [(f"u{i}", f"g{i}", "Li" if i % 3 else "Mg", i % FOLDS, float(y[i]), [int(j) for j in np.flatnonzero(x[i])], [float(v) for v in x[i][x[i] != 0]]) for i in range(N)]
    return stored(spark.createDataFrame(data, "row_uid string, group_id string, ion string, fold int, y double, idx array<int>, val array<double>"), "levels")


def test_codes_keep_the_column_and_every_bin(rng):
    col = rng.integers(0, 5, 1000)
    bins = [rng.integers(0, 3, 1000).astype(np.uint8) for _ in range(3)]
    codes, cells = trees.joint(col, bins)
    assert (cells[codes] == np.column_stack([col, *bins])).all() and len(np.unique(cells, axis=0)) == len(cells) == codes.max() + 1
    assert trees.joint(col[:0], [b[:0] for b in bins])[1].shape == (0, 4)


def test_rows_of_the_larger_child_are_not_counted(rows, monkeypatch):
    populations, grid = {"mixed": None, "li": ["Li"]}, {"a": trees.TreeSettings(2, 3, 8), "b": trees.TreeSettings(2, 2, 16)}
    tasks = [(g, p, s) for g in grid for p in populations for s in (0, 1, -1)]
    seen, real = [], trees.level_sums

    def spied(table, ensembles, *rest):
        found = real(table, ensembles, *rest)
        seen.append((rest[1], {n: (e.skip.copy(), set(found[n][0].tolist()) if n in found else set()) for n, e in enumerate(ensembles.values()) if rest[1] < e.settings.depth}))
        return found

    monkeypatch.setattr(trees, "level_sums", spied)
    fitted = trees.fit(rows, WIDTH, populations, grid, tasks)
    skipped = 0
    for depth, own in seen:
        for skip, nodes in own.values():
            level = np.flatnonzero(skip[2**depth - 1 : 2 ** (depth + 1) - 1])
            assert not nodes & set(level.tolist()) and all((k ^ 1) in nodes for k in level)
            skipped += len(level) if depth else 0
    assert skipped > 20
    for one in fitted.values():
        assert one.skip is None and not one.rooted
        assert not any((c == 8).any() for c in one.split_column), "ties go to the smaller column"


def test_odd_rows_are_counted_like_others(spark, rows):
    """Rows without entries, without a target and with all columns; tasks without rows."""
    odd = spark.createDataFrame([("a", "a", "Li", 0, 2.0, [], []), ("b", "b", "Li", 1, None, [8], [9.0]), ("c", "c", "Mg", 2, 0.5, list(range(WIDTH)), [0.25] * WIDTH)], rows.schema)
    more = stored(rows.unionByName(odd).repartition(7), "odd")
    grid = {"a": trees.TreeSettings(2, 2, 8, min_rows=20)}
    e = trees.fit(more, WIDTH, {"mixed": None}, grid, [("a", "mixed", 0)])["a", "mixed", 0]
    table = more.where("y IS NOT NULL AND fold <> 0").toPandas()
    x = np.zeros((len(table), WIDTH))
    for i, r in enumerate(table.itertuples()):
        x[i, r.idx] = r.val
    node = e.leaves(x, 0)
    for k in np.unique(node):
        assert np.isclose(e.value[0][k], (table.y[node == k] - table.y.mean()).mean())


def test_a_reader_holds_small_row_groups(spark):
    """A reader takes up to 4,096 rows of a row group at once, so groups of packed rows are a few MB however long the file is."""
    big = spark.range(40, numPartitions=1).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([np.random.default_rng(i).bytes(1 << 20)], pa.binary())], ["block"]) for b in batches for i in range(b.num_rows)), "block binary")
    path = stored(big, "groups", SMALL_GROUPS).inputFiles()
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in path]
    sizes = [g.row_group(i).total_byte_size for g in groups for i in range(g.num_row_groups)]
    assert sum(sizes) > 39 << 20 and max(sizes) < 12 << 20


def test_a_pass_sends_few_bytes_at_once(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    with finer(spark):
        assert int(spark.conf.get(name)) <= 16 << 20
    assert spark.conf.get(name, None) == before


def test_binned_rows_are_in_small_row_groups(rows, monkeypatch):
    used, real = [], trees.stored
    monkeypatch.setattr(trees, "stored", lambda *a: used.append(a[2:]) or real(*a))
    grid = {"a": trees.TreeSettings(1, 1)}
    trees.binned(rows, trees.start(rows, WIDTH, {"mixed": None}, [("a", "mixed", 0)], grid), {"mixed": None}, WIDTH)
    assert used == [(SMALL_GROUPS,)]
