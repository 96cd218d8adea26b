"""Fits that run at the same time, full waves of tasks and packed rows."""

import threading

import numpy as np
import pyarrow as pa
import pytest

from ionforge.operators import models, search, trees
from ionforge.operators.sparse import packed, unpacked
from ionforge.session import finer, scratch_path, spread, stored, together

SPLITS = "spark.sql.files.minPartitionNum"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 6))
    data = [(f"u{i}", f"g{i}", "Li" if i % 2 else "Mg", i % 3, float(1 + np.sin(r[0])), list(range(6)), [float(v) for v in r]) for i, r in enumerate(x)]
    return stored(spark.createDataFrame(data, "row_uid string, group_id string, ion string, fold int, y double, idx array<int>, val array<double>"), "together")


def test_rows_are_dealt_in_full_waves(spark):
    slots = spark.sparkContext.defaultParallelism
    assert spread(spark.range(2 * slots + 2), rows=2) == 2 * slots and spread(spark.range(0)) == slots


def test_the_last_of_several_passes_puts_the_setting_back(spark):
    before = spark.conf.get(SPLITS, None)
    first, second = finer(spark), finer(spark)
    first.__enter__(), second.__enter__()
    first.__exit__(None, None, None)
    assert spark.conf.get(SPLITS, None) == str(3 * spark.sparkContext.defaultParallelism)
    second.__exit__(None, None, None)
    assert spark.conf.get(SPLITS, None) == before


def test_an_error_is_raised_when_all_have_ended(spark):
    done, gate = [], threading.Event()

    def bad():
        gate.set()
        raise OSError("lost")

    def good():
        gate.wait(30)
        done.append(spark.range(7).count())

    with pytest.raises(OSError, match="lost"):
        together(spark, [bad, good])
    assert done == [7] and together(spark, [lambda: 1, lambda: 2]) == [1, 2] and together(spark, []) == []


def test_populations_are_fitted_at_the_same_time(spark, rows, monkeypatch):
    both, real = threading.Barrier(2), models.rbf_ridge

    def ridge(*args):
        both.wait(60)  # breaks where the second fit starts after the first one's end
        return real(*args)

    monkeypatch.setattr(models, "rbf_ridge", ridge)
    grid = [c for c in models.candidates() if c["id"] == "krr_scaled_0"]
    found = search.Search(rows, {"mixed_ions": None, "li_only": ["Li"]}, 3, 6, scratch_path(spark, "search"), grid, components=2, size=8)
    assert found.run() == 6 and found.run() == 0
    assert {(r.missing_rows, r.repeated_rows) for r in found.summary().collect()} == {(0, 0)}
    final = found.final_models(found.select(found.summary()))
    assert {p: [f for f, _ in own] for p, own in final.items()} == {"mixed_ions": ["krr"], "li_only": ["krr"]}


def test_passes_read_batches_and_not_rows(rows):
    grid, populations = {"a": trees.TreeSettings(1, 1)}, {"mixed": None, "li": ["Li"]}
    ensembles = trees.start(rows, 6, populations, [("a", "mixed", 0), ("a", "li", 1)], grid)
    table, which = trees.binned(rows, ensembles, populations, 6)
    assert which == [0, 1] and table.count() <= rows.rdd.getNumPartitions()
    batches = list(unpacked(table.toArrow().to_batches()))
    y = np.concatenate([b.column("y").to_numpy() for b in batches])
    assert sorted(y) == sorted(r.y for r in rows.select("y").collect())
    assert sum(b.column("in1").to_numpy(zero_copy_only=False).sum() for b in batches) == 60


def test_packed_batches_come_back_with_nulls_and_slices():
    batch = pa.RecordBatch.from_pydict({"fold": pa.array([0, None, 2, 3]), "b": pa.array([b"x", b"", None, b"yz"])})
    other = batch.slice(1, 2)
    table = pa.Table.from_batches([packed(batch), packed(other)])
    assert [b.to_pydict() for b in unpacked(table.to_batches())] == [batch.to_pydict(), other.to_pydict()]
