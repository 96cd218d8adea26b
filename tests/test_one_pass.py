"""Vectors, training states and their diagnostics in one pass over the rows, against plain versions."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ionforge.constants import ATOMIC_NUMBER
from ionforge.functions import composition
from ionforge.operators import preprocess

PLAIN = ["H", "Fe2O3", "Li1Fe3[P(O2)2]1", "FeFe2(OFe)3", "((H2)3O)10", "(" * 12 + "H" + ")" * 12, "Mg999999O"]
ODD = [None, "", "2Fe", "e", "3", "(", "Fe(OH", "Fe)2(", "(H]", "Fe0", "Fe01", "Fe1000000", "Fe1000001", "()", "H(2O)", "Qq2", "Fe O", "FéO", "a9Fe", "H" * 1025,
       "(" * 13 + "H" + ")" * 13, "(((H999999)999999)999999)999999"]


def test_formulas_of_a_batch_are_read_as_one_by_one(rng):
    texts = [(PLAIN + ODD)[i] for i in rng.integers(0, len(PLAIN + ODD), 500)]
    for array in (pa.array(texts, pa.string()), pa.array(["Fe2", *texts, "3O"], pa.string()).slice(1, len(texts))):
        found = [[] for _ in texts]
        for r, z, n in zip(*(a.tolist() for a in composition.atoms_of(array))):
            found[r].append((z, n))
        assert found == [sorted((ATOMIC_NUMBER[e], n) for e, n in composition.parse(t)[0] or ()) for t in texts]
    ions = [["Li", "Fe", "H", None, "Rb"][i] for i in rng.integers(0, 5, 500)]
    end = composition.Endpoint(pa.array(texts, pa.string()), pa.array(ions, pa.string()))
    other = composition.Endpoint(pa.array(texts[::-1], pa.string()), pa.array(ions, pa.string()))
    for t, t2, ion, left, loading, fraction, differs in zip(texts, texts[::-1], ions, end.left, end.loading, end.fraction, end.differs(other)):
        _, host, own, part = composition.algebra(t, ion)
        assert (left == 0) == (host is None) and differs == (host != composition.algebra(t2, ion)[1])
        assert host is None or (loading, fraction) == (own, part)


def test_plain_formulas_are_not_read_one_by_one(monkeypatch):
    monkeypatch.setattr(composition, "parse", lambda text: pytest.fail(f"{text} was parsed alone"))
    assert len(composition.atoms_of(pa.array(PLAIN, pa.string()))[0]) > len(PLAIN)


def test_states_take_one_pass(spark, rng):
    n, width, folds = 400, 6, 3
    x = rng.normal(size=(n, width)) * (rng.random((n, width)) < 0.4)
    x[:, 2] = 1e6 + rng.normal(size=n)
    x[:, 3], x[:, 5] = 7.0, 0.0
    data = [(int(i % folds), [int(j) for j in np.flatnonzero(r)], [float(v) for v in r[r != 0]]) for i, r in enumerate(x)]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    schema = "fold int, idx array<int>, val array<double>"
    rows = spark.createDataFrame(data, schema).repartition(3).mapInArrow(counted, schema)
    states = {(r["scope"], r["idx"]): r for r in preprocess.fit_states(rows, width, folds).collect()}
    assert seen.value == n and len(states) == (folds + 1) * width
    for (scope, j), r in states.items():
        own = x[np.arange(n) % folds != scope, j]
        assert r["train_rows"] == len(own) and r["active"] == (np.ptp(own) > 1e-12)
        assert np.isclose(r["mean"], own.mean(), rtol=1e-12, atol=1e-12) and np.isclose(r["std"], own.std(), rtol=1e-6, atol=1e-9)


def test_differing_columns_are_those_of_a_dense_comparison(spark, rng):
    width, means = 8, np.array([0.0, 2.0, 0.0, -1.0, 0.5, 0.0, 0.0, 3.0])
    states = spark.createDataFrame([(s, j, bool((j + s) % 4 == 0), float(means[j])) for s in (0, 1) for j in range(width)], "scope int, idx int, active boolean, mean double")
    x = np.where(rng.random((200, width)) < 0.5, means, rng.integers(0, 3, (200, width)))
    data = [(i, i % 3, [int(j) for j in np.flatnonzero(r)], [float(v) for v in r[r != 0]]) for i, r in enumerate(x)]
    rows = spark.createDataFrame(data, "k long, scope int, idx array<int>, val array<double>").repartition(3)
    want = {(i, j) for i in range(200) for j in range(width) if i % 3 < 2 and (j + i % 3) % 4 and abs(x[i, j] - means[j]) > 1e-9}
    diagnosed = preprocess.support_diagnostics(rows, states, ["k"])
    got = [(r["k"], r["idx"]) for r in diagnosed.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert "lambda" not in diagnosed._jdf.queryExecution().executedPlan().toString()
    named = lambda df: df.withColumn("population", F.concat(F.lit("p"), F.col("scope").cast("string"))).drop("scope")
    counts = {r["k"]: r["changed_constants"] for r in preprocess.changed_counts(named(rows), named(states)).collect()}
    assert counts == {i: sum(k == i for k, _ in want) for i in range(200)}


def test_a_level_counts_what_plain_sums_count(rng, monkeypatch):
    from ionforge.operators import trees
    n, width, bins = 300, 5, 4
    x = rng.integers(0, bins, (n, width)) * (rng.random((n, width)) < 0.6)
    y, fold, li = rng.normal(size=n), np.arange(n) % 3, np.arange(n) % 2 == 0
    y[7] = np.nan
    ensembles = {}
    for population, held, depth in (("all", 0, 3), ("all", 0, 2), ("li", -1, 3)):
        e = trees.Ensemble(0.5, trees.TreeSettings(2, depth, bins), np.zeros(width), np.ones(width))
        for _ in range(2):
            size = 2 ** (depth + 1) - 1
            e.split_column.append(np.where(np.arange(size) < 2, [1, 3] + [0] * (size - 2), -1))
            e.split_bin.append(np.ones(size, np.int64))
            e.value.append(rng.normal(size=size))
        ensembles[f"c{depth}", population, held] = e
    row, col = np.nonzero(x)
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
    batch = pa.RecordBatch.from_arrays([
        pa.array(fold, pa.int32()), pa.array(y), pa.array(np.ones(n, bool)), pa.array(li), trees._blobs(col.astype(np.uint16).tobytes(), 2 * ends), trees._blobs(x[row, col].astype(np.uint8).tobytes(), ends)],
        ["fold", "y", "in0", "in1", "columns", "bins0"])
    monkeypatch.setattr(trees, "CHUNK", 70)
    found = trees.count_level([batch.slice(0, 100), batch.slice(100)], ensembles, {"all": None, "li": ["Li"]}, 1, width, [0, 0, 0])
    for number, ((_, population, held), e) in enumerate(ensembles.items()):
        want, dense = np.zeros((2, 2, width + 1, bins)), x.astype(float)
        node, guess = e.leaves(dense, 1), e.predict(dense, 1)
        for i in range(n):
            if fold[i] != held and (li[i] or population == "all") and not np.isnan(y[i]):
                at = 0 if x[i, 1] <= 1 else 1  # the nodes of depth 1
                assert node[i] in ((2,) if at else (3, 4))
                for j, b in [(width, 0)] + [(j, x[i, j]) for j in range(width) if x[i, j]]:
                    want[:, at, j, b] += 1, y[i] - guess[i]
        assert np.allclose(found[number].reshape(want.shape), want)
