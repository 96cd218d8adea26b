"""Large cells grow with their rows, and SimHash brings pairs together."""

import pytest

pytest.importorskip("xxhash")

from pyspark.sql import functions as F  # noqa: E402

from ionforge.llm import simhash_near as near  # noqa: E402

WITHIN = "key long, range int, shown boolean, n int, fp long, bits binary, node long, blocks int"


def meetings(spark, roots_of, blocks):
    within = spark.createDataFrame([(1, 2, False, 9, k, b"", k, blocks) for k in roots_of], WITHIN)
    roots = spark.createDataFrame([(k, r) for k, r in roots_of.items() if r != k], "fp long, root long")
    rows = near.dealt_blocks(within, roots, near.Settings(block_rows=10)).select("i", "j", "side", "node", "root").collect()
    groups, met = {}, set()
    for r in rows:
        groups.setdefault((r.i, r.j), []).append(r)
    for (i, j), own in groups.items():
        met |= {(a.node, b.node) for a in own for b in own if a.root != b.root and a.node < b.node and (i == j or a.side != b.side)}
    return len(rows), met


@pytest.mark.parametrize("strays", [3, 25, 80])
def test_every_pair_of_different_roots_meets(spark, strays):
    roots = {k: 0 if k < 100 - strays else k for k in range(100)}
    count, met = meetings(spark, roots, 10)
    assert met == {(a, b) for a in roots for b in roots if a < b and roots[a] != roots[b]}
    if strays == 3:  # pairs of blocks would be 1,000 rows
        assert count <= 2 * 100 + 3 * 10


def test_simhash_brings_close_fingerprints_together(spark):
    prints = spark.createDataFrame([(10, 5, 3), (11, 5, 3), (12, 5 ^ 7, 3), (13, 2**40 + 2**50 + 2**60 + 2**33 + 2**20 + 2**21, 3), (14, 5, 0)], "node long, fp long, n int")
    assert sorted(map(tuple, near.simhash_pairs(prints).collect())) == [(11, 10), (12, 10)]
    assert near.simhash_pairs(prints.where(F.lit(False))).count() == 0
