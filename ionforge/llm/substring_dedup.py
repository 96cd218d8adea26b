"""Suffix-array deduplication: remove later copies of long byte strings, keep the first.

A byte goes if a string of ``LENGTH`` bytes over it also starts in a document
with a smaller id. Shipping every suffix would copy the corpus ``LENGTH``
times, so suffixes meet in four steps over chunks of documents:

1. *Anchors.* Every window of ``LENGTH`` bytes names its first lowest ``GRAM``-byte
   hash; equal windows name equal anchors. Runs of windows with one anchor are one
   entry. Each chunk sends its distinct anchor hashes to buckets, which answer: held
   by one document, by several, or by many chunks.
2. *Digests.* Chunks send a 128-bit digest of the bytes of each shared run, once with
   its smallest document. Buckets answer with the smallest document of all that hold
   just these bytes, so the inside of a repeated passage is settled without its text,
   and say whether the anchor has other surroundings as well.
3. *Suffix order.* For those, the chunk of the smallest document sends the bytes. A
   bucket sorts the suffixes of such strings, ties by document. Of the neighbours with
   a smaller document in that order, the previous one decides: the longest previous
   factor reaches ``LENGTH`` where it shares so many bytes (a smaller document after
   an equal suffix can't be, ties being sorted). The answer is the smallest document
   that holds each window.
4. *Removal.* Chunks find their runs again, mark every window that an earlier
   document holds, and drop the marked bytes.

Anchors of many chunks are dealt by digest and by single windows in steps 2 and 3, so
a frequent passage meets in many buckets, and a bucket gets a string once per chunk.
All steps over chunks read the same shuffled documents; only hashes, strings and
answers move between them. All of it is replayed by Spark if an executor is lost.

Defined results: null text counts as empty; texts shorter than ``LENGTH`` stay
whole; repeats inside one document and between rows with the same id stay; a
null id comes after all others and never makes anything go; kept bytes may end
inside a character, as strings are bytes; an empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import functions as F

LENGTH = 50
GRAM = 24
SPAN = LENGTH - GRAM + 1
#: Bytes of text in a chunk, of anchor hashes in a bucket, and positions hashed at a time.
CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 2 << 20
PIECE = 1 << 20
#: Windows whose suffixes a bucket sorts at a time; equal windows are always sorted together.
SORTED_AT_ONCE = 1 << 18
#: An anchor in more chunks than this is dealt by single windows.
MANY_CHUNKS = 128
LAST = np.iinfo(np.int64).max
BASE = np.uint64(0x9E3779B97F4A7C15)
POSITION = np.uint64((1 << 24) - 1)


def gram_hashes(b, size):
    """Mixed hash of the ``size`` bytes from every position, joined from hashes of powers of two."""
    power, width, done, out = BASE, 1, 0, None
    h = b.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        while True:
            if size & width:
                if out is None:
                    out, done = h, width
                else:
                    n = len(b) - done - width + 1
                    out = out[:n] * power + h[done : done + n]
                    done += width
            if width * 2 > size:
                break
            h = h[:-width] * power + h[width:]
            power, width = power * power, width * 2
    return mixed(out)


def mixed(value):
    """One-to-one scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return value ^ (value >> np.uint64(32))


class Chunk:
    """Documents of a chunk as one byte array, and their runs of windows with one anchor."""

    def __init__(self, ids, texts):
        # an order of their own: the pieces below must fall alike whenever the chunk is read
        bodies, keys = pc.fill_null(texts, b"").to_pylist(), pc.fill_null(ids, LAST).to_pylist()
        order = pa.array(sorted(range(len(keys)), key=lambda i: (keys[i], bodies[i])), pa.int64())
        self.doc_id, texts = ids.take(order), pa.array(bodies, pa.binary()).take(order)
        self.ids = np.asarray(pc.fill_null(self.doc_id, LAST), np.int64)
        sizes = np.asarray(pc.binary_length(texts), np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.raw = b"".join(texts.to_pylist())
        self.bytes = np.frombuffer(self.raw, np.uint8)
        parts = [self._runs(a) for a in range(0, len(self.bytes) - LENGTH + 1, PIECE)]
        self.hash, self.first, self.last = (np.concatenate([np.empty(0, t), *(p[i] for p in parts)]) for i, t in enumerate((np.uint64, np.int64, np.int64)))
        self.doc = np.searchsorted(self.ends, self.first, side="right")
        self.anchors, self.place = np.unique(self.hash, return_inverse=True)

    def _runs(self, at):
        """Anchor hash, first and last window of every run among the windows from ``at`` on."""
        b = self.bytes[at : at + PIECE + LENGTH - 1]
        n = len(b) - LENGTH + 1
        h = gram_hashes(b, GRAM)
        low = (h & ~POSITION) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while width * 2 <= SPAN:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[:n], low[SPAN - width : SPAN - width + n])
        anchor = (low & POSITION).astype(np.int64)
        whole = np.ones(n, bool)
        ends = self.ends[(self.ends > at) & (self.ends < at + n + LENGTH - 1)] - at
        crossing = (ends[:, None] - np.arange(1, LENGTH)).ravel()
        whole[crossing[(crossing >= 0) & (crossing < n)]] = False
        fresh = whole.copy()
        fresh[1:] &= ~whole[:-1] | (anchor[1:] != anchor[:-1])
        first = np.flatnonzero(fresh)
        stop = ~whole
        stop[first] = True
        edges = np.append(np.flatnonzero(stop), n)
        last = edges[np.searchsorted(edges, first, side="right")] - 1
        # lowest hashes are small numbers; mixed again, they spread evenly over buckets
        return mixed(h[anchor[first]]), first + at, last + at

    def several(self):
        """Whether two documents of the chunk hold an anchor."""
        lowest, highest = np.full(len(self.anchors), LAST), np.full(len(self.anchors), -1)
        np.minimum.at(lowest, self.place, self.doc)
        np.maximum.at(highest, self.place, self.doc)
        return lowest != highest

    def digests(self, flags):
        """Distinct strings of the shared runs as sorted (route, digest), and where they occur.

        ``flags`` are the answers of step 1. A route is the anchor's hash, or half of
        the digest for anchors of many chunks.
        """
        runs = np.flatnonzero(flags[self.place] > 0)
        first, last, doc = self.first[runs], self.last[runs], self.ids[self.doc[runs]]
        raw = self.raw
        both = b"".join(xxhash.xxh3_128_digest(raw[a:z]) for a, z in zip(first.tolist(), (last + LENGTH).tolist()))
        half = np.frombuffer(both, np.uint64).reshape(-1, 2)
        many = flags[self.place[runs]] == 2
        route = np.where(many, half[:, 0], self.hash[runs])
        order = np.lexsort((half[:, 1], route))
        key = np.stack([route, half[:, 1]], 1)[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]).any(1)
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(fresh) - 1
        some = order[fresh]
        smallest = np.full(len(some), LAST)
        np.minimum.at(smallest, entry, doc)
        return Entries(route[some], half[some, 1], smallest, many[some], first[some], last[some], self.hash[runs][some]), (first, last, doc, entry)

    def strings(self, entries, low, other):
        """Strings to be sent in step 3, ordered by (route, bytes), and the pieces of the entries they stand for.

        Returns strings, routes, documents, and per piece: entry, first window in it, number of the string.
        """
        own = np.flatnonzero((entries.smallest == low) & (other | entries.many))
        count = np.where(entries.many[own], entries.last[own] - entries.first[own] + 1, 1)
        entry = np.repeat(own, count)
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        a = entries.first[entry] + offset
        z = np.where(entries.many[entry], a, entries.last[entry]) + LENGTH
        index, raw = {}, self.raw
        which = np.fromiter((index.setdefault(raw[i:j], len(index)) for i, j in zip(a.tolist(), z.tolist())), np.int64, len(a))
        made = list(index)
        docs, at = np.full(len(made), LAST), np.zeros(len(made), np.int64)
        np.minimum.at(docs, which, entries.smallest[entry])
        at[which[::-1]] = np.arange(len(which))[::-1]  # one piece of each string
        route, single = entries.anchor[entry[at]], entries.many[entry[at]]
        if single.any():
            route[single] = row_hashes(sliding_window_view(self.bytes, LENGTH)[a[at[single]]])
        order = np.array(sorted(range(len(made)), key=lambda i: (route[i], made[i])), np.int64)
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        return [made[i] for i in order], route[order], docs[order], (entry, offset, number[which])


class Entries:
    """Distinct strings of a chunk: route, half digest, smallest document, whether many chunks hold the anchor, one occurrence."""

    def __init__(self, route, digest, smallest, many, first, last, anchor):
        self.route, self.digest, self.smallest, self.many = route, digest, smallest, many
        self.first, self.last, self.anchor = first, last, anchor


def row_hashes(rows):
    """Hash of every row of bytes."""
    value = np.zeros(len(rows), np.uint64)
    with np.errstate(over="ignore"):
        for column in rows.T:
            value = value * BASE + column + np.uint64(1)
    return mixed(value)


def earliest_documents(text, starts, docs):
    """Smallest document of every window's equals.

    The windows are cut into groups by a hash of their first and last bytes, so equal
    ones stay together and the memory of a sort is bounded by the largest group.
    """
    words = np.ndarray(len(text) - 7, "<u8", text, strides=(1,))
    with np.errstate(over="ignore"):
        both = mixed((words[starts] * BASE) ^ words[starts + LENGTH - 8])
    count = -(-len(starts) // SORTED_AT_ONCE)
    group = ((both >> np.uint64(40)) * np.uint64(count) >> np.uint64(24)).astype(np.uint16 if count < 65536 else np.uint64)
    windows, low = sliding_window_view(text, LENGTH), np.empty(len(starts), np.int64)
    for g in range(count):
        at = np.flatnonzero(group == g)
        low[at] = previous_smaller(windows[starts[at]], docs[at])
    return low


def previous_smaller(windows, docs):
    """Smallest document of every window's equals, by suffix order and previous smaller documents."""
    suffix = np.ascontiguousarray(windows).view(f"S{windows.shape[1]}").ravel()
    order = np.lexsort((docs, suffix))
    ordered = suffix[order]
    # whether the common prefix with the entry before is the whole length
    reaches = np.concatenate([[False], ordered[1:] == ordered[:-1]])
    head = np.maximum.accumulate(np.where(reaches, 0, np.arange(len(order))))
    low = np.empty(len(order), np.int64)
    low[order] = docs[order][head]
    return low


def bucket_of(hashes, buckets):
    return ((hashes >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def pieces(bucket, buckets):
    """Where each bucket's entries lie, for entries sorted by bucket."""
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    return [(p, int(edges[p]), int(edges[p + 1])) for p in np.flatnonzero(np.diff(edges)).tolist()]


def blob(array):
    return np.ascontiguousarray(array).tobytes()


def table(rows, schema):
    return pa.table({f.name: pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)}, schema=schema)


B, I, L = pa.binary(), pa.int32(), pa.int64()
HASHES = pa.schema([("bucket", I), ("chunk", I), ("hashes", B), ("several", B)])
SHARED = pa.schema([("chunk", I), ("bucket", I), ("flags", B)])
DIGESTS = pa.schema([("bucket", I), ("chunk", I), ("routes", B), ("digests", B), ("docs", B)])
LOWEST = pa.schema([("chunk", I), ("bucket", I), ("low", B), ("other", B)])
STRINGS = pa.schema([("bucket", I), ("chunk", I), ("text", B), ("sizes", B), ("docs", B)])
EARLIEST = pa.schema([("chunk", I), ("bucket", I), ("runs", B), ("lengths", B), ("docs", B)])
RESULT = pa.schema([("doc_id", L), ("n_bytes", L), ("n_removed", L), ("n_spans", L), ("kept", B)])


def ddl(schema):
    names = {B: "binary", I: "int", L: "long"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def as_chunk(rows):
    return Chunk(rows["doc_id"].combine_chunks(), rows["body"].combine_chunks())


def send_hashes(buckets):
    def run(rows):
        chunk = as_chunk(rows)
        several, number = chunk.several(), rows["chunk"][0].as_py()
        made = [(p, number, blob(chunk.anchors[a:b]), blob(several[a:b])) for p, a, b in pieces(bucket_of(chunk.anchors, buckets), buckets)]
        return table(made, HASHES)

    return run


def answer_hashes(many_chunks):
    """Per chunk and anchor, 0: held by one document, 1: shared, 2: shared by many chunks."""

    def run(rows):
        own = [np.frombuffer(x, np.uint64) for x in rows["hashes"].to_pylist()]
        all_hashes = np.concatenate(own)
        _, place, count = np.unique(all_hashes, return_inverse=True, return_counts=True)
        several = np.zeros(len(count), bool)
        several[place[np.frombuffer(b"".join(rows["several"].to_pylist()), bool)]] = True
        flags = np.where(count > many_chunks, 2, np.where((count > 1) | several, 1, 0)).astype(np.uint8)[place]
        ends = np.cumsum([len(x) for x in own])
        made = [(c, b, blob(flags[e - len(x) : e])) for c, b, x, e in zip(rows["chunk"].to_pylist(), rows["bucket"].to_pylist(), own, ends)]
        return table(made, SHARED)

    return run


def joined(answers, name, kind):
    """One column of a chunk's answers of one step, in the order of the buckets."""
    answers = answers.filter(pc.is_valid(answers[name]))
    parts = answers[name].to_pylist()
    return np.frombuffer(b"".join(parts[i] for i in np.argsort(np.asarray(answers["bucket"]), kind="stable")), kind)


def send_digests(buckets):
    def run(rows, answers):
        if not rows.num_rows:
            return table([], DIGESTS)
        entries, _ = as_chunk(rows).digests(joined(answers, "flags", np.uint8))
        number = rows["chunk"][0].as_py()
        made = [
            (p, number, blob(entries.route[a:b]), blob(entries.digest[a:b]), blob(entries.smallest[a:b]))
            for p, a, b in pieces(bucket_of(entries.route, buckets), buckets)
        ]
        return table(made, DIGESTS)

    return run


def answer_digests(rows):
    """Per chunk and string: the smallest document that holds it, and whether its route has other strings."""
    own = [np.frombuffer(x, np.uint64) for x in rows["routes"].to_pylist()]
    route, digest = np.concatenate(own), np.frombuffer(b"".join(rows["digests"].to_pylist()), np.uint64)
    docs = np.frombuffer(b"".join(rows["docs"].to_pylist()), np.int64)
    order = np.lexsort((digest, route))
    route, digest = route[order], digest[order]
    new_route = np.concatenate([[True], route[1:] != route[:-1]])
    new = new_route | np.concatenate([[True], digest[1:] != digest[:-1]])
    first, number = np.flatnonzero(new), np.cumsum(new) - 1
    low, other = np.empty(len(order), np.int64), np.empty(len(order), bool)
    low[order] = np.minimum.reduceat(docs[order], first)[number]
    strings = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_route))
    other[order] = (strings > 1)[np.cumsum(new_route) - 1]
    ends = np.cumsum([len(x) for x in own])
    made = [(c, b, blob(low[e - len(x) : e]), blob(other[e - len(x) : e])) for c, b, x, e in zip(rows["chunk"].to_pylist(), rows["bucket"].to_pylist(), own, ends)]
    return table(made, LOWEST)


def send_strings(buckets):
    def run(rows, answers):
        if not rows.num_rows:
            return table([], STRINGS)
        chunk = as_chunk(rows)
        entries, _ = chunk.digests(joined(answers, "flags", np.uint8))
        strings, route, docs, _ = chunk.strings(entries, joined(answers, "low", np.int64), joined(answers, "other", bool))
        sizes, number = np.fromiter(map(len, strings), np.int32, len(strings)), rows["chunk"][0].as_py()
        made = [(p, number, b"".join(strings[a:b]), blob(sizes[a:b]), blob(docs[a:b])) for p, a, b in pieces(bucket_of(route, buckets), buckets)]
        return table(made, STRINGS)

    return run


def answer_strings(rows):
    """Per chunk and string: the smallest document of each window, as runs of equal values."""
    text = np.frombuffer(b"".join(rows["text"].to_pylist()), np.uint8)
    own_sizes = [np.frombuffer(x, np.int32) for x in rows["sizes"].to_pylist()]
    sizes = np.concatenate(own_sizes).astype(np.int64)
    docs = np.frombuffer(b"".join(rows["docs"].to_pylist()), np.int64)
    count = sizes - LENGTH + 1
    begin = np.cumsum(sizes) - sizes
    context = np.repeat(np.arange(len(sizes), dtype=np.int32), count)
    starts = np.arange(count.sum()) + np.repeat(begin - np.cumsum(count) + count, count)
    low = earliest_documents(text, starts, docs[context])
    fresh = np.concatenate([[True], (low[1:] != low[:-1]) | (context[1:] != context[:-1])])
    at = np.flatnonzero(fresh)
    length = np.diff(np.append(at, len(low))).astype(np.uint8)
    runs = np.bincount(context[at], minlength=len(sizes)).astype(np.uint8)
    run_ends, ends = np.cumsum(runs, dtype=np.int64), np.cumsum([len(x) for x in own_sizes])
    made = []
    for c, b, x, e in zip(rows["chunk"].to_pylist(), rows["bucket"].to_pylist(), own_sizes, ends):
        a = e - len(x)
        p, q = (run_ends[a - 1] if a else 0), run_ends[e - 1]
        made.append((c, b, blob(runs[a:e]), blob(length[p:q]), blob(low[at[p:q]])))
    return table(made, EARLIEST)


def expanded(begin, end):
    """For every range: its number, and each index in it."""
    size = end - begin
    number = np.repeat(np.arange(len(size)), size)
    return number, np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)


def remove(rows, answers):
    """The documents of a chunk without the bytes that earlier documents hold."""
    if not rows.num_rows:
        return table([], RESULT)
    chunk = as_chunk(rows)
    entries, (first, last, doc, entry) = chunk.digests(joined(answers, "flags", np.uint8))
    low, other = joined(answers, "low", np.int64), joined(answers, "other", bool)
    mark = np.zeros(len(chunk.bytes) + 1, np.int32)
    # strings that an earlier document holds whole
    gone = low[entry] < doc
    np.add.at(mark, first[gone], 1)
    np.add.at(mark, last[gone] + LENGTH, -1)
    # those that this document is the first to hold whole: window by window
    strings, _, _, (piece_entry, piece_offset, piece_string) = chunk.strings(entries, low, other)
    if strings:
        runs, lengths, lowest = joined(answers, "runs", np.uint8).astype(np.int64), joined(answers, "lengths", np.uint8).astype(np.int64), joined(answers, "docs", np.int64)
        occurrence, piece = expanded(np.searchsorted(piece_entry, entry), np.searchsorted(piece_entry, entry, side="right"))
        keep = ~gone[occurrence]
        occurrence, piece = occurrence[keep], piece[keep]
        first_run, before = np.cumsum(runs) - runs, np.cumsum(lengths) - lengths
        string = piece_string[piece]
        part, run = expanded(first_run[string], first_run[string] + runs[string])
        start = first[occurrence[part]] + piece_offset[piece[part]] + before[run] - before[first_run[string[part]]]
        earlier = lowest[run] < doc[occurrence[part]]
        np.add.at(mark, start[earlier], 1)
        np.add.at(mark, start[earlier] + lengths[run[earlier]] + LENGTH - 1, -1)
    removed = np.cumsum(mark[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(removed)])
    opens = removed.copy()
    opens[1:] &= ~removed[:-1]
    opens[chunk.starts[chunk.starts < chunk.ends]] = removed[chunk.starts[chunk.starts < chunk.ends]]
    opened = np.concatenate([[0], np.cumsum(opens)])
    kept = [chunk.bytes[a:b][~removed[a:b]].tobytes() for a, b in zip(chunk.starts, chunk.ends)]
    return pa.table({
        "doc_id": chunk.doc_id, "n_bytes": chunk.ends - chunk.starts, "n_removed": total[chunk.ends] - total[chunk.starts],
        "n_spans": opened[chunk.ends] - opened[chunk.starts], "kept": pa.array(kept, pa.binary()),
    }).cast(RESULT)


def deduplicate(docs, chunk_bytes=CHUNK_BYTES, bucket_bytes=BUCKET_BYTES, many_chunks=MANY_CHUNKS):
    """One row per document: id, bytes, bytes and spans removed, and the bytes that stay."""
    text = F.coalesce(F.col("text"), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunks = max(1, -(-total // chunk_bytes))
    buckets = max(1, -(-total // (bucket_bytes * 2)))  # about half a byte of hashes per byte of text
    chunk = F.pmod(F.xxhash64("doc_id", text), F.lit(chunks)).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(text, "UTF-8").alias("body"), chunk.alias("chunk"))
    by_chunk = rows.groupBy("chunk")

    def step(answers, send, schema):
        return by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(send, ddl(schema))

    def bucketed(sent, answer, schema):
        return sent.groupBy("bucket").applyInArrow(answer, ddl(schema))

    shared = bucketed(by_chunk.applyInArrow(send_hashes(buckets), ddl(HASHES)), answer_hashes(many_chunks), SHARED)
    lowest = bucketed(step(shared, send_digests(buckets), DIGESTS), answer_digests, LOWEST)
    known = shared.unionByName(lowest, allowMissingColumns=True)
    earliest = bucketed(step(known, send_strings(buckets), STRINGS), answer_strings, EARLIEST)
    return step(known.unionByName(earliest, allowMissingColumns=True), remove, RESULT)
