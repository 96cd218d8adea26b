"""Near-duplicates by SimHash with pivot distance tables.

A fingerprint takes the majority of each bit over the XXH64 hashes of all word
shingles of a whole text. Distinct fingerprints that differ in at most
``distance`` bits are linked:

1. the 64 bits are cut into ``distance + 2`` blocks; a pair within the distance
   agrees on two blocks at least, so every choice of two blocks is a key that
   brings such pairs together;
2. the distance to the first reference fingerprint (pivot) cuts a key's rows
   into ranges; rows near a lower edge are also shown to the range below, so a
   frequent key spreads over many cells and no pair is lost;
3. within a cell, rows are sorted by that distance; a pair is discarded when
   any of its pivot distances differ by more than ``distance`` (the triangle
   inequality), and survivors are verified bit by bit.

Pivot distances of 64 random bits spread by 4 only, so alone they would leave
nearly all pairs; that is why step 1 comes first. A cell reports a spanning
forest of its links, not all pairs. Components come from union-find inside the
tasks and rounds between them over written tables.

Defined results: null text counts as empty; texts without words have the zero
fingerprint, which is linked like any other; texts with fewer words than a
shingle use the whole sequence; a component is named by its smallest id, null
ids are ignored for that and get their component's name (null if it has none);
repeated rows are repeated in the result; empty tables give empty results.
"""

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from ionforge.llm.common import ascii_lower, rowed
from ionforge.operators.components import token_components
from ionforge.session import stored

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42
DISTANCE = 3
SHINGLE = 3
#: Width of a range of distances to the first pivot.
RANGE = 8
HASHES_AT_ONCE = 65_536


def pivots(count=16):
    """Reference fingerprints: hashes of their numbers."""
    return np.array([xxhash.xxh64_intdigest(str(i), SEED) for i in range(count)], np.uint64)


def majority(text, size=SHINGLE):
    """Fingerprint of a lower-cased text in bytes, as an unsigned integer."""
    words = WORDS.findall(text)
    if not words:
        return 0
    shingles = zip(*[words[i:] for i in range(size)]) if len(words) >= size else [words]
    hashes = map(lambda s: xxhash.xxh64_intdigest(b" ".join(s), SEED), shingles)
    total, ones = max(len(words) - size + 1, 1), np.zeros(64, np.int64)
    for start in range(0, total, HASHES_AT_ONCE):
        part = np.fromiter(hashes, np.uint64, min(HASHES_AT_ONCE, total - start))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def fingerprint(text, size=SHINGLE):
    """Column of the fingerprints of whole texts, as the signed long of the same 64 bits."""

    @F.arrow_udf("long")
    def of(lowered: pa.Array) -> pa.Array:
        prints = [majority(t, size) for t in lowered.cast(pa.binary()).to_pylist()]
        return pa.array(np.array(prints, np.uint64).view(np.int64))

    return of(ascii_lower(text))


def block_keys(fp, distance):
    """A key for every choice of two of the ``distance + 2`` bit blocks."""
    edges = [round(64 * i / (distance + 2)) for i in range(distance + 3)]
    blocks = [(a, b - a) for a, b in zip(edges, edges[1:])]

    def bits(start, width):
        return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1))

    keys = []
    for i, ((s, n), (t, m)) in enumerate(combinations(blocks, 2)):
        keys.append(F.lit(i << 32) + F.shiftleft(bits(s, n), m) + bits(t, m))
    return F.array(*keys)


def cells(prints, distance):
    """Every fingerprint in the cells where it can meet a partner: key, range of the first pivot distance, shown copy or not."""
    first = F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(pivots(1).view(np.int64)[0]))))
    rows = prints.select("fp", first.cast("int").alias("near")).select("fp", "near", F.explode(block_keys(F.col("fp"), distance)).alias("key"))
    home = F.floor(F.col("near") / RANGE).cast("int")
    own = F.struct(home.alias("range"), F.lit(False).alias("shown"))
    below = F.struct((home - 1).alias("range"), F.lit(True).alias("shown"))
    places = F.when(F.col("near") % RANGE < distance, F.array(own, below)).otherwise(F.array(own))
    return rows.withColumn("place", F.explode(places)).select("key", "place.range", "place.shown", "near", "fp")


def spanning(a, b):
    """Links of a node to the smallest node of its component, for every node that isn't it."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    rest = label != np.arange(len(nodes))
    return nodes[rest], nodes[label[rest]]


def cell_links(key, near, fp, shown, distance, references):
    """Links among rows sorted by cell and first pivot distance: pivot test, then the bits."""
    table = np.bitwise_count(fp[None, :] ^ references[:, None]).astype(np.int16)
    found_a, found_b, pending = [], [], 0
    at = np.arange(len(fp) - 1)
    step = 1
    while len(at):
        at = at[at + step < len(fp)]
        other = at + step
        at = at[(key[at] == key[other]) & (near[other] - near[at] <= distance)]
        other = at + step
        fine = ~(shown[at] & shown[other])
        i, j = at[fine], other[fine]
        for row in table:
            close = np.abs(row[i] - row[j]) <= distance
            i, j = i[close], j[close]
        true = np.bitwise_count(fp[i] ^ fp[j]) <= distance
        found_a.append(fp[i[true]])
        found_b.append(fp[j[true]])
        pending += int(true.sum())
        if pending > 1_000_000:
            a, b = spanning(np.concatenate(found_a), np.concatenate(found_b))
            found_a, found_b, pending = [a], [b], 0
        step += 1
    if not pending and not any(map(len, found_a)):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return spanning(np.concatenate(found_a), np.concatenate(found_b))


def links(prints, distance=DISTANCE, pivot_count=16):
    """Links (u > v) that connect all fingerprints (column ``fp``, distinct) within the distance."""
    references = pivots(pivot_count)

    def run(batches):
        held = None  # rows of the last cell that a later row may still meet
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch["key"].to_numpy(zero_copy_only=False), batch["range"].to_numpy(zero_copy_only=False).astype(np.int64)], 1)
            cell = key[:, 0] * 16 + key[:, 1] + 1  # a key has fewer than 2^36 values, a range is -1 to 8
            now = (cell, batch["near"].to_numpy(zero_copy_only=False), batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64), batch["shown"].to_numpy(zero_copy_only=False))
            rows = now if held is None else tuple(np.concatenate(x) for x in zip(held, now))
            cell, near, fp, shown = rows
            a, b = cell_links(cell, near, fp, shown, distance, references)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a.view(np.int64), b.view(np.int64))), pa.array(np.minimum(a.view(np.int64), b.view(np.int64)))], ["u", "v"])
            keep = (cell == cell[-1]) & (near >= near[-1] - distance)
            held = tuple(x[keep] for x in rows)

    placed = cells(prints, distance).repartition("key", "range").sortWithinPartitions("key", "range", "near", "fp")
    return placed.mapInArrow(run, "u long, v long").distinct()


def components(edges):
    """A common node (``root``) for every linked node (``fp``) but the root itself, by union-find in the tasks and rounds between them."""
    found, _ = token_components(edges.select(*[F.col(c).cast("string").alias(c) for c in ("u", "v")]))
    return found.select(F.col("token").cast("long").alias("fp"), F.col("rep").cast("long").alias("root"))


def classes(prints_by_id, distance=DISTANCE):
    """For rows of (doc_id, fp): every distinct fingerprint with its root and the component's smallest id."""
    distinct = prints_by_id.groupBy("fp").agg(F.min("doc_id").alias("low"))
    rooted = distinct.join(components(links(distinct.select("fp"), distance)), "fp", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rooted.join(named, "root").select("fp", "root", "component_id")


def resolve(docs, distance=DISTANCE, size=SHINGLE):
    """One row per document: id, fingerprint as 16 hex digits and the component's smallest id."""
    prints = stored(docs.select("doc_id", fingerprint(F.col("text"), size).alias("fp")), "simhash")
    found = classes(prints, distance).select("fp", "component_id")
    return prints.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs, distance=DISTANCE, size=SHINGLE):
    """The documents that stay, one of each component (that of the smallest id), with all their columns."""
    prints = stored(docs.select("doc_id", fingerprint(F.col("text"), size).alias("fp")), "simhash")
    found = classes(prints, distance)
    rows = rowed(docs, id=F.col("doc_id"), fp=fingerprint(F.col("text"), size))
    stay = rows.join(found, "fp").where(F.col("id").eqNullSafe(F.col("component_id")))
    return stay.dropDuplicates(["root"]).select("row.*")
