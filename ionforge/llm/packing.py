"""Best-fit-decreasing packing of tokenised documents into sequences of a fixed length.

1. Every whole text is encoded and ends with an id of its own (``end_id``);
   documents longer than a sequence are cut into pieces of its length, and only
   the last piece may be shorter.
2. Pieces are counted by length, which leaves at most ``length`` numbers however
   many documents there are. Best fit decreasing runs over these counts: a
   segment tree over remaining capacities finds the tightest capacity that any
   open sequence has, in logarithmic time. Pieces of one length that go into
   sequences of one capacity are placed together as a run, so the result is
   that of placing piece after piece.
3. A piece's rank among those of its length (counted by task, then summed up
   over the tasks) names its run, and the run its sequence and offset.

Runs: while lengths fall, a stretch of equal sequences is split at most three
times per length and takes at most sqrt(2 x length) different lengths, so
there are fewer than 3 x length x sqrt(2 x length) runs (0.4 million of five
numbers for 2,048 ids), and a few thousand in practice. That is the bound of
what the driver holds and what tasks receive.

Defined results: null text counts as empty, and an empty text is one piece of
the ending id alone; repeated rows and equal or null ids are documents of their
own; texts of any length are packed whole; an empty table has no pieces. Only
the id and text columns are read, so other columns can't clash.
"""

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ionforge.llm.bpe import SLICE_CHARS, vocabulary
from ionforge.llm.common import slices
from ionforge.session import stored

LENGTH = 2048
END_ID = 0
#: Fields of a run: rank of its first piece, first sequence, pieces side by side in one sequence, offset of the first.
RUN_FIELDS = ("rank", "sequence", "beside", "offset")


class Capacities:
    """Segment tree over remaining capacities 0..top; a leaf holds the stretches of sequences with that capacity."""

    def __init__(self, top):
        self.size = 1 << top.bit_length()
        self.filled = bytearray(2 * self.size)  # whether any sequence lies below a node
        self.stretches = [[] for _ in range(top + 1)]

    def put(self, capacity, first, count):
        if not count:
            return
        self.stretches[capacity].append((first, count))
        node = self.size + capacity
        while node and not self.filled[node]:
            self.filled[node] = 1
            node >>= 1

    def take(self, capacity, most):
        """At most ``most`` sequences of a capacity, as (first, count)."""
        first, count = self.stretches[capacity].pop()
        if count > most:
            self.stretches[capacity].append((first + most, count - most))
            return first, most
        if not self.stretches[capacity]:
            node = self.size + capacity
            self.filled[node] = 0
            while node > 1 and not self.filled[node ^ 1]:
                node >>= 1
                self.filled[node] = 0
        return first, count

    def tightest(self, least):
        """The smallest capacity of at least ``least`` that a sequence has, or None."""
        node = self.size + least
        if self.filled[node]:
            return least
        while node > 1:
            if not node & 1 and self.filled[node + 1]:  # the first filled neighbour to the right, then down its left edge
                node += 1
                while node < self.size:
                    node = 2 * node if self.filled[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return None


def place(counts, length):
    """Best fit decreasing over the number of pieces of every length 1..length.

    Returns the runs of every length (a list of ``RUN_FIELDS`` rows, ranks
    rising) and the number of sequences.
    """
    open_ones, opened, runs = Capacities(length), 0, {}
    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        left, rank, rows = counts[size], 0, []
        while left:
            capacity = open_ones.tightest(size)
            beside = (capacity or length) // size
            whole, rest = divmod(left, beside)  # a sequence takes pieces until no more fit: it stays the tightest
            if capacity is None:
                capacity, first, count = length, opened, max(whole, 1)
                opened += count
            else:
                first, count = open_ones.take(capacity, max(whole, 1))
            if whole:
                used, remains = count * beside, capacity - beside * size
            else:
                used, remains = rest, capacity - rest * size
            rows.append((rank, first, beside, length - capacity))
            open_ones.put(remains, first, count)
            rank, left = rank + used, left - used
        runs[size] = rows
    return runs, opened


def pieces(docs, vocab_path, length=LENGTH, end_id=END_ID, with_ids=True):
    """Pieces of all documents: id, piece number, start, length, CRC-32 of the ids, and the ids themselves if wanted.

    ``task`` and ``local`` say which task has cut a piece and how many pieces of
    the same length it had cut before.
    """
    fields = [docs.select("doc_id").schema[0], *[StructField(n, LongType()) for n in ("piece", "start", "length", "ids_crc32", "task", "local")]]
    fields += [StructField("token_ids", ArrayType(IntegerType()))] * with_ids

    def run(batches):
        vocab, task = vocabulary(vocab_path), TaskContext.get().partitionId()
        seen = np.zeros(length + 1, np.int64)
        for batch in batches:
            text = pc.fill_null(batch.column("text"), "")
            for a, b in slices(pc.utf8_length(text).to_pylist(), SLICE_CHARS):
                ids, size = vocab.encode(text.slice(a, b - a).to_pylist())
                doc, piece, start, cut, flat = cut_up(ids, size, length, end_id)
                local = seen[cut] + order_within(cut)
                seen += np.bincount(cut, minlength=length + 1)
                raw, edges = memoryview(flat.astype("<u4").tobytes()), np.concatenate([[0], np.cumsum(cut)])
                crc = np.fromiter((zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(edges[:-1].tolist(), edges[1:].tolist())), np.int64, len(cut))
                columns = [batch.column("doc_id").slice(a, b - a).take(pa.array(doc))]
                columns += [pa.array(c) for c in (piece, start, cut, crc, np.full(len(cut), task, np.int64), local)]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return docs.select("doc_id", "text").mapInArrow(run, StructType(fields))


def cut_up(ids, size, length, end_id):
    """Document number, piece number, start and length of every piece, and all ids with the ending ones."""
    flat = np.insert(ids, np.cumsum(size), end_id)
    size = size + 1
    number = -(-size // length)
    doc = np.repeat(np.arange(len(size)), number)
    piece = order_within(doc)
    start = piece * length
    return doc, piece, start, np.minimum(size[doc] - start, length), flat


def order_within(values):
    """For every entry the number of equal entries before it."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(values) else np.empty(0, bool)
    first = np.flatnonzero(fresh)
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values)) - np.repeat(first, np.diff(np.append(first, len(values))))
    return rank


def placed(cut, length=LENGTH):
    """Give every stored piece its sequence and offset."""
    by_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    # one row per length and task: a window has as many rows as there were tasks
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    by_task = stored(by_task.select("length", "task", "n", F.coalesce(before, F.lit(0)).alias("before")), "pack-counts")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row per length at most
    runs, _ = place(counts, length)
    sizes = np.array(sorted(runs), np.int64)
    table = np.array([row for s in sizes.tolist() for row in runs[s]], np.int64).reshape(-1, len(RUN_FIELDS))
    edge = np.concatenate([[0], np.cumsum([len(runs[s]) for s in sizes.tolist()])]).astype(np.int64)
    ranked = cut.join(by_task.drop("n"), ["length", "task"]).withColumn("rank", F.col("before") + F.col("local")).drop("task", "local", "before")
    fields = [f for f in ranked.schema.fields if f.name != "rank"] + [StructField("sequence_id", LongType()), StructField("offset", LongType())]

    def run(batches):
        # ranks of one length lie between the first ranks of its runs: one sorted key finds them all
        step = max(counts.values(), default=0) + 1
        keys = np.repeat(np.arange(len(sizes)), np.diff(edge)) * step + table[:, 0]
        for batch in batches:
            size, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            first, sequence, beside, offset = table[np.searchsorted(keys, np.searchsorted(sizes, size) * step + rank, side="right") - 1].T
            turn = rank - first
            kept = [batch.column(f.name) for f in fields[:-2]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence + turn // beside), pa.array(offset + turn % beside * size)], [f.name for f in fields])

    return ranked.mapInArrow(run, StructType(fields))


def pack(docs, vocab_path, length=LENGTH, end_id=END_ID, with_ids=True):
    """Every piece of every document with the sequence and the offset it goes to."""
    cut = stored(pieces(docs, vocab_path, length, end_id, with_ids), "pieces")
    return placed(cut, length)


def sequences(packed):
    """One row per sequence: its ids, and the ids, pieces and offsets of the documents in it (at most ``length`` of them)."""
    part = F.struct("offset", "doc_id", "piece", "length", "token_ids")
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return rows.select("sequence_id", F.flatten("parts.token_ids").alias("token_ids"), F.transform("parts", lambda p: p.dropFields("token_ids")).alias("parts"))
