"""Toxicity scores from a factorization machine over hashed terms.

A document is the set of its hashed lower-case terms: its words, and the first
``STEMS`` letters of longer words, so inflected forms count together. Its logit is a bias, a
weight per term and the inner product of the terms' factors for every pair, so
a pair of terms that is harmless apart can count together.

The machine is fitted on a bounded sample of labelled rows (``max_rows``, by
hash order of the ids); from it the ``max_terms`` buckets that tell the labels
apart best are counted with Spark and kept. Scoring reads every whole text.

Defined results: null or empty texts have no terms and get the bias' score;
repeated label rows of an id count once with the largest label; labels other
than 0 and 1, null labels and null ids are not learnt from; without labels of
both classes every score is the smoothed share of label 1; an empty table
gives an empty result. Language, source, id and label are never features.
"""

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ionforge.llm.common import fold, slices, text_or_empty
from ionforge.session import stored

WORD = re.compile(r"\w+")
STEMS = (4, 5, 6)
MEMO_WORDS = 50_000
#: Characters of text that are held as Python objects at a time.
SLICE_CHARS = 1_000_000


@dataclass
class Settings:
    bits: int = 20          # hashed term space
    max_rows: int = 20_000  # labelled rows that the machine is fitted on, at most
    max_terms: int = 1024   # buckets kept, at most
    min_docs: int = 3       # documents a kept bucket occurs in
    min_gain: float = 6.0   # log-likelihood that a kept bucket gains
    factors: int = 8
    steps: int = 3000
    batch: int = 256
    rate: float = 0.03
    decay: float = 1e-5         # of the weights
    factor_decay: float = 2e-4  # of the factors: what a term says alone is left to its weight
    threshold: float = 0.3
    seed: int = 7


@dataclass
class Machine:
    """Fitted parameters; ``buckets`` are sorted hash buckets, row i of the arrays belongs to bucket i."""

    bits: int
    buckets: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray
    memo: dict = field(default_factory=dict, repr=False)

    def __post_init__(self):
        self.index = {b: i for i, b in enumerate(self.buckets.tolist())}

    def terms(self, text):
        """Indexes of the kept buckets that a text's terms fall into."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        found = set()
        for word in set(WORD.findall(text.lower())):
            at = self.memo.get(word)
            if at is None:
                at = self.memo[word] = tuple(self.index[b] for b in hashed(word, self.bits) if b in self.index)
            if at:
                found.update(at)
        return sorted(found)

    def logits(self, rows):
        """Logits of rows of term indexes."""
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((i for r in rows for i in r), np.int64, int(size.sum()))
        row = np.repeat(np.arange(len(rows)), size)
        return self.bias + forward(row, flat, len(rows), self.weight, self.factor)[0]


def hashed(word, bits):
    """Buckets of a word and of its stems."""
    terms = [word, *(f"{word[:n]}~" for n in STEMS if len(word) > n)]
    return [zlib.crc32(t.encode("utf-8", "surrogatepass")) & ((1 << bits) - 1) for t in terms]


def buckets_of(text, bits):
    return sorted({b for w in set(WORD.findall(text.lower())) for b in hashed(w, bits)})


def forward(row, flat, n, weight, factor):
    """Linear part plus half the squared sum less the sum of squares, and the sums of factors by row."""
    linear = np.bincount(row, weight[flat], n)
    total = np.zeros((n, factor.shape[1]))
    np.add.at(total, row, factor[flat])
    square = np.bincount(row, (factor[flat] ** 2).sum(1), n)
    return linear + 0.5 * ((total**2).sum(1) - square), total


def sample(docs, labels, settings, train):
    """Labelled texts of the sample with their hashed terms: id, label, terms."""
    wanted = (
        labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isin(0, 1))
        .groupBy("id").agg(F.max("label").alias("label"))
        .where(train("id"))
        .orderBy(F.xxhash64("id"), "id").limit(settings.max_rows)  # the documented bound
    )
    texts = docs.select(F.col("doc_id").alias("id"), text_or_empty().alias("body"))
    bits = settings.bits

    @F.arrow_udf("array<int>")
    def terms(body: pa.Array) -> pa.Array:
        return pa.array([buckets_of(t, bits) for t in body.to_pylist()], pa.list_(pa.int32()))

    # at most max_rows small rows are broadcast
    return texts.join(F.broadcast(wanted), "id").select("id", "label", terms("body").alias("terms"))


def strongest(rows, settings):
    """Buckets with the largest log-likelihood ratio between the labels, counted over the sample."""
    classes = rows.agg(F.count("*").alias("n"), F.sum("label").alias("pos")).first()
    n, pos = classes["n"], classes["pos"] or 0
    counts = rows.select("label", F.explode("terms").alias("bucket")).groupBy("bucket").agg(F.sum("label").alias("a"), F.count("*").alias("all"))

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    a, total = F.col("a").cast("double"), F.col("all").cast("double")
    gain = part(a, total * pos / max(n, 1)) + part(total - a, total * (n - pos) / max(n, 1))
    gain = gain + part(pos - a, (n - total) * pos / max(n, 1)) + part((n - pos) - (total - a), (n - total) * (n - pos) / max(n, 1))
    top = counts.where(F.col("all") >= settings.min_docs).select("bucket", gain.alias("gain")).where(F.col("gain") >= settings.min_gain).orderBy(F.desc("gain"), "bucket").limit(settings.max_terms)
    return n, pos, np.array(sorted(r["bucket"] for r in top.collect()), np.int64)


def fit(docs, labels, settings=None, train=None):
    """Fit the machine; ``train`` maps an id column name to the condition of rows to learn from (default: all)."""
    settings = settings or Settings()
    rows = stored(sample(docs, labels, settings, train or (lambda _: F.lit(True))), "toxic-sample")
    n, pos, buckets = strongest(rows, settings)
    k = settings.factors
    empty = Machine(settings.bits, np.empty(0, np.int64), float(np.log((pos + 0.5) / (n - pos + 4.5))), np.zeros(0), np.zeros((0, k)))
    if not len(buckets) or pos in (0, n):
        return empty
    # ids of kept buckets only: at most max_rows x max_terms small integers reach the driver
    kept = F.array(*[F.lit(int(b)) for b in buckets])
    data = rows.select("id", "label", F.array_intersect("terms", kept).alias("terms")).toPandas().sort_values("id", kind="stable")
    return train_machine([np.searchsorted(buckets, t) for t in data["terms"]], data["label"].to_numpy(float), buckets, settings)


def train_machine(rows, label, buckets, settings):
    """Adam on the logistic loss with weight decay, over shuffled batches."""
    rng = np.random.default_rng(settings.seed)
    m = len(buckets)
    share = label.mean()
    params = [np.array([np.log(share / (1 - share))]), np.zeros(m), rng.normal(0, 0.01, (m, settings.factors))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    order = np.empty(0, np.int64)
    for step in range(1, settings.steps + 1):
        if not len(order):
            order = rng.permutation(len(rows))
        pick, order = order[: settings.batch], order[settings.batch :]
        flat = np.concatenate([rows[i] for i in pick]).astype(np.int64)
        row = np.repeat(np.arange(len(pick)), size[pick])
        bias, weight, factor = params
        score, total = forward(row, flat, len(pick), weight, factor)
        slope = (1 / (1 + np.exp(-(bias[0] + score))) - label[pick]) / len(pick)
        by_term = np.zeros_like(factor)
        np.add.at(by_term, flat, slope[row][:, None] * (total[row] - factor[flat]))
        grads = [np.array([slope.sum()]), np.bincount(flat, slope[row], m) + settings.decay * weight, by_term + settings.factor_decay * factor]
        rate = settings.rate * (1 - step / (settings.steps + 1))
        for p, g, u, v in zip(params, grads, first, second):
            u += 0.1 * (g - u)
            v += 0.001 * (g * g - v)
            p -= rate * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    bias, weight, factor = params
    return Machine(settings.bits, buckets, float(bias[0]), weight, factor)


def score(df, machine, text_col="text", score_col="toxicity"):
    """Add the probability of label 1 for every whole text."""
    parts = (machine.bits, machine.buckets, machine.bias, machine.weight, machine.factor)

    @F.arrow_udf("double")
    def probability(text: pa.Array) -> pa.Array:
        machine = at_work(parts)
        text, logits = pc.fill_null(text, ""), []
        for a, b in slices(pc.utf8_length(text).to_pylist(), SLICE_CHARS):
            logits.append(machine.logits([machine.terms(t) for t in text.slice(a, b - a).to_pylist()]))
        return pa.array(1 / (1 + np.exp(-np.clip(np.concatenate([np.empty(0), *logits]), -500, 500))))

    return df.withColumn(score_col, probability(F.col(text_col)))


#: The one machine that a worker keeps, with what it has looked up.
AT_WORK = []


def at_work(parts):
    if not AT_WORK or any(not np.array_equal(a, b) for a, b in zip(AT_WORK[0], parts)):
        AT_WORK[:] = [parts, Machine(*parts)]
    return AT_WORK[1]


def held_out(column):
    """Rows that the registered query never learns from."""
    return fold(column, 4) == 2
