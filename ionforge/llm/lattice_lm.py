"""Language-model scores from a subword lattice over an existing vocabulary.

Every piece of the vocabulary has a unigram probability. The probability of a
word is the sum over all its segmentations into pieces, by a forward recursion
in log space; a document is its words and one end, so its probability is their
product: the marginal over all segmentations of the whole text. Characters
without a piece are spelled with byte pieces, so every text has a probability.

The vocabulary's own order gives the first scores (a piece of rank r weighs
1/(r + 10)). They are then re-estimated on the word counts of all training
documents: expected piece counts over all segmentations (forward-backward),
``rounds`` times, spread over the partitions of the distinct words.

Beside it stands the add-half word unigram. Both are sums over the distinct
words of a text: the ``HEAD`` most frequent words are looked up from a broadcast
table of that size, all others are joined with the table of all words.

Defined results: null text counts as empty, and an empty text is its end alone;
without training documents counts are zero and pieces keep their first
probabilities; rows that repeat an id and text get equal scores; an empty table
gives an empty result; words and texts of any length are scored whole.
"""

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import functions as F

from ionforge.llm.common import fold
from ionforge.session import stored

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
BOUNDARY = "▁"
#: Frequent words in the broadcast table.
HEAD = 131_072
ROUNDS = 2
SMOOTHING = 0.01
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Distinct words that a task counts before it passes them on.
COUNTED_WORDS = 300_000
WORDS_AT_ONCE = 20_000


class Lattice:
    """Piece strings as hashes of their code points, and the graph of a batch of words."""

    def __init__(self, path):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size() + 1  # the last is the end of a document
        self.end = self.size - 1
        ids = [i for i in range(self.end) if not (model.is_control(i) or model.is_unknown(i))]
        pieces = {model.id_to_piece(i): i for i in ids if not model.is_byte(i)}
        self.bytes = np.array([i for i in ids if model.is_byte(i)], np.int64)
        self.longest = max(map(len, pieces))
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.pieces = hashes[order], np.array(list(pieces.values()), np.int64)[order]
        assert (np.diff(self.hashes) > 0).all()
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.hashes >> np.uint64(44)] = True
        weight = np.zeros(self.size)
        weight[ids] = 1 / (np.arange(len(ids)) + 10.0)
        weight[self.end] = weight[ids].max()
        self.first = weight / weight.sum()

    def _hash(self, text):
        value = 0
        for c in text:
            value = (value * int(BASE) + ord(c) + 1) % (1 << 64)
        return value

    def graph(self, words, log_p):
        """Edges of the words' lattices: start node, end node, id, weight; and where each word's nodes begin and end.

        Ids from ``size`` on stand for characters spelled in bytes; their byte lists are returned last.
        """
        texts = [BOUNDARY + w for w in words]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(code)
        word = np.repeat(np.arange(len(texts)), size)
        ends = np.cumsum(size)
        left = ends[word] - np.arange(n)  # characters from here to the word's end
        # one node before every character and one after each word
        node = np.arange(n) + word
        value = code.astype(np.uint64) + np.uint64(1)
        starts, lengths, found = [], [], []
        running = np.zeros(n, np.uint64)
        at = np.arange(n)
        for k in range(1, self.longest + 1):
            at = at[left[at] >= k]
            if not len(at):
                break
            running[at] = running[at] * BASE + value[at + k - 1]
            h = running[at]
            maybe = np.flatnonzero(self.seen[h >> np.uint64(44)])
            place = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
            hit = self.hashes[place] == h[maybe]
            starts.append(at[maybe[hit]])
            lengths.append(np.full(int(hit.sum()), k))
            found.append(self.pieces[place[hit]])
        start, length, piece = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (starts, lengths, found))
        single = np.zeros(n, bool)
        single[start[length == 1]] = True
        bare = np.flatnonzero(~single)
        letters, which = np.unique(code[bare], return_inverse=True)
        spelled = [self.bytes[list(chr(c).encode("utf-8", "surrogatepass"))] for c in letters]
        scores = np.concatenate([log_p, [log_p[s].sum() for s in spelled]])
        start, length = np.concatenate([start, bare]), np.concatenate([length, np.ones(len(bare), np.int64)])
        piece = np.concatenate([piece, self.size + which])
        begin = ends - size + np.arange(len(texts))
        return node[start], node[start] + length, piece, scores, begin, begin + size, spelled

    def forward(self, edges, begin, total):
        """Log of the summed weight of all paths to every node, by distance from the word's beginning."""
        start, end, weight = edges
        alpha = np.full(total, -np.inf)
        alpha[begin] = 0.0
        depth = end - begin[np.searchsorted(begin, end, side="right") - 1]
        order = np.lexsort((end, depth))
        start, end, weight = start[order], end[order], weight[order]
        cuts = np.flatnonzero(np.diff(depth[order])) + 1
        for a, b in zip([0, *cuts], [*cuts, len(order)]):
            if a == b:
                continue
            value, node = alpha[start[a:b]] + weight[a:b], end[a:b]
            first = np.flatnonzero(np.concatenate([[True], np.diff(node) > 0]))
            top = np.maximum.reduceat(value, first)
            total_exp = np.add.reduceat(np.exp(value - np.repeat(top, np.diff(np.append(first, b - a)))), first)
            alpha[node[first]] = top + np.log(total_exp)
        return alpha

    def log_words(self, words, log_p):
        """Natural log probability of each word, over all its segmentations."""
        if not len(words):
            return np.empty(0)
        s, e, piece, scores, begin, end, _ = self.graph(words, log_p)
        return self.forward((s, e, scores[piece]), begin, end[-1] + 1)[end]

    def expected(self, words, counts, log_p):
        """Expected count of every piece over all segmentations of counted words."""
        s, e, piece, scores, begin, end, spelled = self.graph(words, log_p)
        total = int(end[-1]) + 1
        weight = scores[piece]
        alpha = self.forward((s, e, weight), begin, total)
        # the same recursion on the mirrored graph
        beta = self.forward((total - 1 - e, total - 1 - s, weight), np.sort(total - 1 - end), total)[::-1]
        word = np.searchsorted(begin, s, side="right") - 1
        share = np.exp(alpha[s] + weight + beta[e] - alpha[end[word]]) * counts[word]
        by_id = np.bincount(piece, share, len(scores))
        made = by_id[: self.size]
        for i, letters in enumerate(spelled):
            np.add.at(made, letters, by_id[self.size + i])
        return made


@lru_cache(maxsize=2)
def lattice(path):
    return Lattice(path)


def lowered(column):
    return pc.ascii_lower(pc.fill_null(column, "")).to_pylist()


def word_counts(docs, learn):
    """Every distinct word of all documents with its count over the training documents (0 if only others hold it)."""

    def count(batches):
        seen, other = Counter(), set()

        def flush():
            rows = [*seen.items(), *((w, 0) for w in other if w not in seen)]
            seen.clear()
            other.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.int64())], ["word", "c"])

        for batch in batches:
            for text, train in zip(lowered(batch["text"]), batch["train"].to_pylist()):
                (seen if train else other).update(WORDS.findall(text))
                if len(seen) + len(other) > COUNTED_WORDS:
                    yield flush()
        yield flush()

    return docs.select("text", learn.alias("train")).mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def estimate(words, end_count, path, rounds=ROUNDS, smoothing=SMOOTHING):
    """Piece probabilities after ``rounds`` of re-estimation on the counted words; the driver gets one number per piece."""
    model = lattice(path)
    prob = model.first
    for _ in range(rounds):
        log_p = np.log(np.maximum(prob, 1e-300))

        def run(batches, log_p=log_p):
            own = lattice(path)
            made = np.zeros(own.size)
            for batch in batches:
                w, c = batch["word"].to_pylist(), batch["c"].to_numpy(zero_copy_only=False).astype(float)
                for a in range(0, len(w), WORDS_AT_ONCE):
                    made += own.expected(w[a : a + WORDS_AT_ONCE], c[a : a + WORDS_AT_ONCE], log_p)
            some = np.flatnonzero(made)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(made[some])], ["piece", "n"])

        sums = words.where("c > 0").select("word", "c").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros(model.size)
        counts[sums["piece"].to_numpy(np.int64)] = sums["n"].to_numpy(float)
        counts[model.end] = end_count
        usable = model.first > 0
        counts[usable] += smoothing
        prob = np.where(usable, counts, 0) / counts[usable].sum() if counts.sum() > smoothing * usable.sum() * 1.0001 else model.first
    return np.log(np.maximum(prob, 1e-300))


def scored_words(words, log_p, path):
    """Add the log10 lattice probability of every word."""

    def run(batches):
        own = lattice(path)
        for batch in batches:
            w = batch["word"].to_pylist()
            parts = [own.log_words(w[a : a + WORDS_AT_ONCE], log_p) for a in range(0, len(w), WORDS_AT_ONCE)]
            value = np.concatenate([*parts, np.empty(0)]) / np.log(10)
            yield pa.RecordBatch.from_arrays([batch["word"], batch["c"], pa.array(value)], ["word", "c", "lattice"])

    return words.mapInArrow(run, "word string, c long, lattice double")


def split_texts(docs, head, log_end, base_end, known_end):
    """Per document: sums over the end and the frequent words, and the other words with their counts."""

    def run(batches):
        table = head.value
        schema = pa.schema([
            ("doc_id", pa.int64()), ("print", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()),
            ("lattice", pa.float64()), ("tail", pa.list_(pa.struct([("word", pa.string()), ("n", pa.int32())]))),
        ])
        for batch in batches:
            rows = {name: [] for name in schema.names[1:]}
            for text in lowered(batch["text"]):
                words = WORDS.findall(text)
                n_known, base, value, tail = known_end, base_end, log_end, []
                for word, n in Counter(words).items():
                    found = table.get(word)
                    if found is None:
                        tail.append({"word": word, "n": n})
                    else:
                        n_known += n * found[0]
                        base += n * found[1]
                        value += n * found[2]
                made = (xxhash.xxh3_64_intdigest(text) - (1 << 63), len(words) + 1, n_known, base, value, tail)
                for name, v in zip(schema.names[1:], made):
                    rows[name].append(v)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), *(pa.array(rows[f.name], f.type) for f in list(schema)[1:])], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, print long, n_tokens long, n_known long, base double, lattice double, tail array<struct<word: string, n: int>>"
    )


def score(docs, path, learn=None, head_size=HEAD, rounds=ROUNDS):
    """One row per document: id, token counts, base score and the lattice's log10 probability of the text.

    ``learn`` is the condition of rows to learn from (default: all).
    """
    learn = F.lit(True) if learn is None else learn
    spark = docs.sparkSession
    words = stored(word_counts(docs, learn), "lm-words")
    total = words.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    ends = docs.where(learn).count()
    n, v = (total["n"] or 0) + ends, total["v"] + (ends > 0)
    log_p = estimate(words, ends, path, rounds)
    table = stored(scored_words(words, log_p, path), "lm-scores")
    den = float(np.log10(n + 0.5 * (v + 1)))
    base_of = F.log10(F.col("c") + 0.5) - den
    top = table.orderBy(F.desc("c"), "word").limit(head_size).select("word", (F.col("c") > 0).cast("int"), base_of, "lattice")
    head = spark.sparkContext.broadcast({r[0]: (r[1], r[2], r[3]) for r in top.collect()})  # head_size rows at most
    rows = split_texts(docs, head, float(log_p[lattice(path).end] / np.log(10)), float(np.log10(ends + 0.5)) - den, int(ends > 0))
    sums = F.struct("n_tokens", "n_known", "base", "lattice")
    # texts without rare words get a filler that no word equals, as words hold no blank
    filler = F.array(F.struct(F.concat(F.lit(" "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("print").cast("string")).alias("word"), F.lit(0).alias("n")))
    tail = F.when(F.size("tail") > 0, F.col("tail")).otherwise(filler)
    flat = rows.select("doc_id", "print", sums.alias("own"), F.posexplode(tail).alias("at", "item"))
    flat = flat.select("doc_id", "print", F.when(F.col("at") == 0, F.col("own")).alias("own"), "item.word", "item.n")
    joined = flat.join(table, "word", "left")
    times = F.col("n").cast("double")
    grouped = joined.groupBy("doc_id", "print").agg(
        F.count("own").alias("copies"), F.max("own.n_tokens").alias("n_tokens"), F.max("own.n_known").alias("head_known"),
        F.max("own.base").alias("head_base"), F.max("own.lattice").alias("head_lattice"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"),
        F.sum(F.when(F.col("n") > 0, times * base_of).otherwise(0.0)).alias("tail_base"),
        F.sum(F.when(F.col("n") > 0, times * F.col("lattice")).otherwise(0.0)).alias("tail_lattice"),
    )
    per = F.col("copies")  # rows that repeat an id and text are one group
    return grouped.withColumn("copy", F.explode(F.sequence(F.lit(1), per.cast("int")))).select(
        "doc_id", "n_tokens", (F.col("head_known") + (F.col("known") / per).cast("long")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.col("tail_base") / per).alias("base_score"), (F.col("head_lattice") + F.col("tail_lattice") / per).alias("score"),
    )


def held_out(column):
    """Rows that the registered query never learns from."""
    return fold(column, 5) == 1
