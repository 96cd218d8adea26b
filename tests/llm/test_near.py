"""Near-duplicate documents against brute force, with every odd case."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("xxhash")

from ionforge.llm import simhash_near as near  # noqa: E402

SCHEMA = "doc_id long, text string, fp string"


def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    shared = " ".join(rng.choices(words, k=60))
    rows, at = [], 0
    for family in range(12):
        base = rng.choices(words, k=rng.choice([7, 40, 300, 900]))
        for copy in range(rng.choice([1, 2, 6])):
            own = list(base)
            for _ in range(copy * len(own) // 60):
                own[rng.randrange(len(own))] = "Changed"
            rows.append((at, f"{shared} {' '.join(own)}" if len(base) >= 300 else " ".join(own)))
            at += 1
    return rows + [(None, "only here, without an id at all"), (900, None), (901, ""), (902, " \n"), (903, "Two words"), (904, "two WORDS"), (904, "two WORDS"), (905, "two other")]


def expected(rows):
    sets = [frozenset(near.shingle_hashes((t or "").lower().encode(), 5).tolist()) for _, t in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or len(a & b) >= 0.8 * len(a | b) > 0:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    groups = {}
    for (i, _), r in zip(rows, root):
        groups.setdefault(r, []).append(i)
    return sorted((min((i for i in g if i is not None), default=None) for g in groups.values()), key=lambda v: (v is None, v))


def test_near_copies_go_and_others_stay(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "mine") for i, t in rows], SCHEMA).withColumn("__fp", F.lit(1)).withColumn("key", F.lit("k"))
    for share in (0.001, 0.2):  # every shingle frequent, and the common passage only
        stay = near.deduplicate(docs, near.Settings(hot_share=share))
        assert stay.columns == docs.columns
        got = [r["doc_id"] for r in stay.collect()]
        assert sorted(got, key=lambda v: (v is None, v)) == expected(rows)
    assert near.deduplicate(docs.limit(0)).count() == 0


def test_forests_hold_real_pairs_of_least_distance():
    a, b, d = np.array([3, 3, 2], np.uint64), np.array([1, 2, 1], np.uint64), np.array([5, 1, 2])
    assert near.least_forest(a, b, d).tolist() == [1, 2]
    assert sorted(near.least_forests(a, b, d, 2)[2].tolist()) == [1, 2, 5]
