"""Packing, prefix trie and whitening against brute force and direct solutions."""

import bisect
import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from ionforge.llm import bpe, packing, prefix_trie, whitening  # noqa: E402

BPE = public_tokenizers.path("word_bpe_49k.json")


# --- tokens ---------------------------------------------------------------------------------------------------------
def test_every_code_point_is_cut_and_lowered_like_the_library():
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(BPE)
    vocab, rng = bpe.Vocabulary(BPE), random.Random(3)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x18000 or rng.random() < 0.01)]
    texts = [f"a{chr(c)}b {chr(c) * 2} x'{chr(c)}s" for c in points] + ["<|ENDOFTEXT|> a<|endoftext|>b", "a\x1cb \x1d\x85c　d", "\U000105d2̇"]
    ids, size = vocab.encode(texts)
    at = np.cumsum(size)
    want = library.encode_batch(texts, add_special_tokens=False)
    assert [t for t, w, b, n in zip(texts, want, at, size) if w.ids != ids[b - n : b].tolist()] == []


def test_a_store_that_forgets_encodes_alike(monkeypatch):
    monkeypatch.setattr(bpe, "STORE_CHUNKS", 50)
    vocab, fresh, rng = bpe.Vocabulary(BPE), bpe.Vocabulary(BPE), random.Random(4)
    for _ in range(30):
        text = " ".join(f"word{rng.randrange(200)}, <|endoftext|>" if rng.random() < 0.1 else f"w{rng.randrange(90)}." for _ in range(60))
        fresh.reset()
        assert vocab.encode([text])[0].tolist() == fresh.encode([text])[0].tolist()


# --- packing --------------------------------------------------------------------------------------------------------
def one_by_one(lengths, top):
    """Remaining capacities after best fit decreasing, piece after piece."""
    free = []
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(free, n)
        bisect.insort(free, (free.pop(at) if at < len(free) else top) - n)
    return free


@pytest.mark.parametrize("top,most,seed", [(16, 16, 0), (100, 40, 1), (2048, 2048, 2), (2048, 300, 3), (7, 1, 4)])
def test_runs_place_like_piece_after_piece(top, most, seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, most) for _ in range(3000)]
    counts = {n: lengths.count(n) for n in set(lengths)}
    runs, opened = packing.place(counts, top)
    filled = {}
    for size, n in counts.items():
        rows = runs[size]
        ends = [r[0] for r in rows[1:]] + [n]
        for (rank, first, beside, offset), end in zip(rows, ends):
            for r in range(rank, end):
                filled.setdefault(first + (r - rank) // beside, []).append((offset + (r - rank) % beside * size, size))
    for parts in filled.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= top
    assert len(filled) == opened and sorted(top - sum(s for _, s in p) for p in filled.values()) == one_by_one(lengths, top)


def test_segment_tree_finds_the_tightest():
    rng, tree, held = random.Random(1), packing.Capacities(37), {}
    for _ in range(3000):
        c = rng.randrange(38)
        if rng.random() < 0.5:
            tree.put(c, 0, 1)
            held[c] = held.get(c, 0) + 1
        elif held.get(c):
            tree.take(c, 1)
            held[c] -= 1
        least = rng.randrange(38)
        assert tree.tightest(least) == min((c for c, n in held.items() if n and c >= least), default=None)


def test_packing_of_odd_documents(spark):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(BPE)
    long = " ".join(f"word{i % 97} other{i % 89}" for i in range(9000))
    rows = [(1, "The quick brown fox"), (2, None), (2, ""), (None, "no id"), (None, "no id"), (5, long), (6, long), (7, "x " * 63), (7, "x " * 63)] + [(100 + i, "same text of a third") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("task", "local", "length", "rank", "token_ids")})
    packed = packing.pack(docs.repartition(3), BPE, length=64)
    got = sorted(((r["doc_id"] or -1), r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["token_ids"])) for r in packed.collect())
    want = []
    for i, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(i or -1, k, 64 * k, len(p), zlib.crc32(struct.pack(f"<{len(p)}I", *p)), tuple(p)) for k, p in enumerate(ids[a : a + 64] for a in range(0, len(ids), 64))]
    assert got == sorted(want)
    whole = packing.sequences(packed).collect()
    assert len(whole) == len(one_by_one([w[3] for w in want], 64))
    for r in whole:
        edges = np.cumsum([0, *[p["length"] for p in r["parts"]]]).tolist()
        assert [p["offset"] for p in r["parts"]] == edges[:-1] and len(r["token_ids"]) == edges[-1] <= 64
    assert packing.pack(docs.limit(0), BPE).count() == 0


# --- prefix trie ----------------------------------------------------------------------------------------------------
def all_prefixes(rows):
    """Every node by brute force over lists of prefixes."""
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: tuple(x[2:] for x in sorted(t)) for c, t in own.items()}
    grown = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        grown[c] = own.get(c - int(math.fmod(c, 100)), ())[:h] + t[h:]
    members, children = {}, {}
    for c, t in grown.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    leaves, saved, found = {}, {}, []
    for k in sorted(members, key=len, reverse=True):
        below = children.get(k, [])
        leaves[k] = sum(leaves[b] for b in below) or 1
        saved[k] = sum(saved[b] for b in below) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
        ends = ",".join(str(c) for c in sorted(members[k]) if grown[c] == k)
        found.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(below), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=str)


def trie_of(table):
    rows = prefix_trie.trie(prefix_trie.regrown(prefix_trie.sequences(table))).drop("turn_id").collect()
    return sorted((tuple(r) for r in rows), key=str)


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture
def many_shards(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("kind", ["mixed", "one text", "copies"])
def test_trie_equals_all_prefixes(many_shards, kind):
    rng, rows = random.Random(kind), []
    for c in [*range(-130, 260), None, 10**12 + 5]:
        n = rng.choice([0, 1, 2, 3, 5, 9]) if rng.random() < 0.9 else 60
        for t in range(n if kind != "copies" or c is None or c % 3 else 300 if c == 3 else 4):
            turn = rng.choice([t, t, t, None, 3]) if kind == "mixed" else t
            text = rng.choice(["x", "yy", "", None, "é😀"]) if kind == "mixed" or kind == "copies" and c is not None and c % 3 else "x"
            rows.append((c, turn, rng.choice(["u", "a", None]) if kind == "mixed" else "u", text))
    table = many_shards.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("turns", "digest", "turn_id", "points", "ids", "__one")})
    assert trie_of(table) == all_prefixes(rows)


def test_members_of_a_hot_conversation_are_digested_in_order(many_shards):
    rows = [(i, 0, "u", "same") for i in range(1000, 2500)] + [(7, 0, "u", "other")]
    assert trie_of(many_shards.createDataFrame(rows, SCHEMA).repartition(9)) == all_prefixes(rows)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie_of(empty) == [] and trie_of(spark.createDataFrame([(None, 1, "u", "x")], SCHEMA)) == []


# --- whitening ------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("size,n", [(5, 300), (32, 200), (8, 4), (3, 1), (1, 50)])
def test_rank_one_updates_and_combining_equal_a_direct_decomposition(rng, size, n):
    x = (rng.normal(size=(n, size)) * np.linspace(1, 80, size)).round() + 1e5
    if size == 8:
        x[:, 3] = x[:, 2]
    x[n // 2 :: 3] = x[0]
    scatter = (x - x.mean(0)).T @ (x - x.mean(0))
    parts = [whitening.Spectrum.empty(size) for _ in range(3)]
    for i, row in enumerate(x):
        parts[min(2, i % 5)].add(row)
    whole = parts[0].combine(parts[1]).combine(parts[2])
    top = max(np.linalg.eigvalsh(scatter)[-1], 1.0)
    assert whole.n == n and np.allclose(whole.mean, x.mean(0))
    assert np.abs(whole.values - np.linalg.eigvalsh(scatter)).max() < 1e-11 * top
    assert np.abs((whole.basis * whole.values) @ whole.basis.T - scatter).max() < 1e-11 * top
    assert np.abs(whole.basis.T @ whole.basis - np.eye(size)).max() < 1e-12


def test_secular_roots_near_a_pole():
    d, z = np.array([1.0, 1.0 + 1e-9, 2.0, 5.0]), np.array([1e-7, 1.0, 1e-9, 3.0])
    values, vectors = whitening.secular(d, z)
    assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-13
    assert np.abs((vectors * values) @ vectors.T - np.diag(d) - np.outer(z, z)).max() < 1e-13


def embedded(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(c) for c in ("vector", "whitened", "at", "n", "deviation")})


def test_whitening_equals_numpy(many_shards, rng):
    vectors = rng.normal(size=(400, 12)).astype(np.float32)
    vectors[100:230] = vectors[7]  # a vector that a third of all rows repeat
    rows = [(i if i % 50 else None, v.tolist()) for i, v in enumerate(vectors)]
    bad = [(900, None), (901, [None] * 12), (902, [float("nan")] * 12), (903, [float("inf")] + [0.0] * 11), (904, []), (905, [1.0])]
    got = whitening.whiten(embedded(many_shards, rows + bad).repartition(40)).toPandas()
    x = np.floor(1024 * vectors.astype(float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    centred = x - sums / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1]
    want = {(i if i % 50 else None, k): v for i, r in enumerate(centred @ basis[:, :8] / np.sqrt(values[:8])) for k, v in enumerate(r, 1)}
    assert len(got) == 8 * n and set(got["n"]) == {n} and got["identity_error"].max() < 1e-10
    for k, part in got.groupby("component"):
        assert abs(part["explained"].iloc[0] - values[k - 1] / values.sum()) < 1e-12
        known = part[part["vec_id"].notna()]
        pairs = np.array([(r.whitened, want[(int(r.vec_id), k)]) for r in known.itertuples()])
        assert min(np.abs(pairs[:, 0] - pairs[:, 1]).max(), np.abs(pairs[:, 0] + pairs[:, 1]).max()) < 1e-9
    exact = sorted((((n * x - sums) ** 2).sum(1)).tolist() * 8)
    assert sorted(map(int, got["deviation"])) == exact


def test_whitening_without_variance_and_without_rows(spark):
    flat = whitening.whiten(embedded(spark, [(i, [0.5, -0.25]) for i in range(6)])).collect()
    assert len(flat) == 12 and {r["whitened"] for r in flat} == {0.0} and {int(r["deviation"]) for r in flat} == {0}
    assert whitening.whiten(embedded(spark, [(1, None)])).count() == 0 and whitening.whiten(embedded(spark, []).limit(0)).count() == 0
    wide = whitening.whiten(embedded(spark, [(1, [3e30, 1.0]), (2, [-3e30, 2.0]), (3, [0.0, 3.0])])).collect()
    assert len(wide) == 6 and all(math.isfinite(r["whitened"]) for r in wide)
