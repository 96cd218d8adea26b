"""No pair of similar texts is lost: many pairs in a cell, far fingerprints, large cells, equal fingerprints."""

import random

import pytest

pytest.importorskip("xxhash")

from ionforge.llm import simhash_near as near  # noqa: E402
from tests.llm.test_near import expected  # noqa: E402


def family(count, seed=3):
    """Copies of one text with one changed word each: similar only where the changes are side by side."""
    rng = random.Random(seed)
    base = [f"v{rng.randrange(10**6)}" for _ in range(60)]
    rows = []
    for at in range(count):
        own = list(base)
        own[at % 60] = f"x{at}"
        rows.append((at, " ".join(own)))
    return rows


def staying(spark, rows, settings):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(r["doc_id"] for r in near.deduplicate(docs, settings).collect())


def test_more_pairs_than_forests_are_all_compared(spark):
    rows = family(55)
    assert staying(spark, rows, near.Settings(forests=1)) == expected(rows)


def test_pairs_with_far_fingerprints_are_found(spark):
    rng = random.Random(7)
    rows = []
    for at in range(0, 200, 2):  # 4 and 5 shingles, 4 in common
        words = [f"u{rng.randrange(10**6)}" for _ in range(9)]
        rows += [(at, " ".join(words[:8])), (at + 1, " ".join(words))]
    assert staying(spark, rows, near.Settings()) == list(range(0, 200, 2))


def test_large_cells_are_cut_into_blocks(spark, monkeypatch):
    sizes, plain = [], near.candidates

    def seen(rows, settings, count):
        sizes.append(rows.groupBy(*near.GROUP).count().agg({"count": "max"}).first()[0] or 0)
        return plain(rows, settings, count)

    monkeypatch.setattr(near, "candidates", seen)
    rows = family(110)
    assert staying(spark, rows, near.Settings(block_rows=20)) == expected(rows)
    assert max(sizes) < 70


def test_different_sets_with_equal_fingerprints_stay_apart(spark):
    rows = [(node, 7, bytes(64), 5, [1]) for node in (1, 2)]
    prints = spark.createDataFrame(rows, "node long, fp long, bits binary, n int, keys array<long>")
    assert near.cells(prints, 0.8).select("node").distinct().count() == 2
