"""Approximate nearest neighbours with learned partitions.

The index is fitted on a bounded sample (``max_sample`` distinct vectors by hash
order): a nearest-neighbour graph of the sample is cut into balanced parts, by
repeated majority votes of the neighbours under a capacity, and a small network
learns each vector's share of neighbours in every part. Every row is then dealt
to its most probable part, queries to their ``probes`` most probable ones, and
all rows of those parts are ranked by their exact distance.

Parts are cut into blocks of at most ``block_rows`` rows and ``block_queries``
queries by hash, from measured counts, so a part (or one vector that a third of
all rows share) is spread over tasks. Every row is indexed; no bucket is capped.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows with a null id or vectors of another
length than most of the sample; rows of one id count as its smallest vector;
ties go to the smaller id; a query without other candidates has no rows;
an empty table gives an empty result.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ionforge.session import stored


@dataclass
class Settings:
    max_sample: int = 8192
    neighbours: int = 30
    parts: int = 16
    probes: int = 12
    hidden: int = 64
    epochs: int = 30
    block_rows: int = 4096
    block_queries: int = 1024
    seed: int = 3


@dataclass
class Router:
    """A network with one hidden layer: vector to the probability of every part."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def probabilities(self, x):
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        logits = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        logits -= logits.max(1, keepdims=True)
        e = np.exp(logits)
        return e / e.sum(1, keepdims=True)


def usable(df, id_col="vec_id", vector_col="embedding"):
    """Ids with their vector in double precision, one row per id."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(finite & F.exists("v", lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def neighbour_graph(x, k):
    """The k nearest other vectors of each, in blocks."""
    k = min(k, len(x) - 1)
    square, found = (x**2).sum(1), np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 1024):
        d = square[None, :] - 2 * x[a : a + 1024] @ x.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        found[a : a + 1024] = np.argpartition(d, k - 1, axis=1)[:, :k] if k else 0
    return found


def balanced_parts(x, graph, parts, rng, rounds=12):
    """Parts of about equal size with few graph edges between them."""
    n = len(x)
    room = -(-n * 11 // (10 * parts))
    centre = x[rng.choice(n, parts, replace=False)]
    part = np.zeros(n, np.int64)
    for turn in range(rounds):
        if turn < 4:  # a start: balanced nearest centres
            wish = x @ centre.T - 0.5 * (centre**2).sum(1)
        else:  # votes of the neighbours, both ways
            wish = np.zeros((n, parts))
            source = np.repeat(np.arange(n), graph.shape[1])
            np.add.at(wish, (source, part[graph.ravel()]), 1.0)
            np.add.at(wish, (graph.ravel(), part[source]), 1.0)
            wish[np.arange(n), part] += 0.5
        part = fill(wish, room)
        centre = np.stack([x[part == p].mean(0) if (part == p).any() else centre[p] for p in range(parts)])
    return part


def fill(wish, room):
    """Give each row its most wished part that has room, the most decided rows first."""
    order = np.argsort(-wish, axis=1, kind="stable")
    top = np.take_along_axis(wish, order[:, :2], 1)
    free, part = np.full(wish.shape[1], room), np.empty(len(wish), np.int64)
    for i in np.argsort(-(top[:, 0] - top[:, -1]), kind="stable"):
        for p in order[i]:
            if free[p]:
                free[p] -= 1
                part[i] = p
                break
    return part


def train_router(x, share, settings, rng):
    """Adam on the cross entropy between a vector's neighbour shares and the predicted parts."""
    h, parts = settings.hidden, share.shape[1]
    params = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], h)), np.zeros(h), rng.normal(0, (2 / h) ** 0.5, (h, parts)), np.zeros(parts)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    step = 0
    for _ in range(settings.epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 256):
            pick = order[a : a + 256]
            w1, b1, w2, b2 = params
            hidden = np.maximum(x[pick] @ w1 + b1, 0)
            logits = hidden @ w2 + b2
            e = np.exp(logits - logits.max(1, keepdims=True))
            slope = (e / e.sum(1, keepdims=True) - share[pick]) / len(pick)
            back = (slope @ w2.T) * (hidden > 0)
            grads = [x[pick].T @ back, back.sum(0), hidden.T @ slope + 1e-4 * w2, slope.sum(0)]
            step += 1
            for p, g, u, v in zip(params, grads, first, second):
                u += 0.1 * (g - u)
                v += 0.001 * (g * g - v)
                p -= 0.003 * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Router(*params)


def fit(vectors, settings=None):
    """Router from a bounded sample of distinct vectors; None without any."""
    settings = settings or Settings()
    rows = vectors.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(settings.max_sample).collect()
    sizes = [len(r["v"]) for r in rows]
    if not sizes:
        return None, 0
    width = max(sorted(set(sizes)), key=sizes.count)
    x = np.array([r["v"] for r in rows if len(r["v"]) == width])
    rng = np.random.default_rng(settings.seed)
    parts = max(1, min(settings.parts, len(x) // 8))
    if parts == 1:
        return Router(np.zeros((width, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)), width
    graph = neighbour_graph(x, settings.neighbours)
    part = balanced_parts(x, graph, parts, rng)
    share = np.zeros((len(x), parts))
    np.add.at(share, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph.ravel()]), 1.0)
    share[np.arange(len(x)), part] += 1.0
    return train_router(x, share / share.sum(1, keepdims=True), settings, rng), width


def matrix(column):
    """Rows of a list column as a matrix."""
    flat = np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), float)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def routed(vectors, router, probes):
    """Add the ``probes`` most probable parts of every vector."""

    @F.arrow_udf("array<int>")
    def parts_of(v: pa.Array) -> pa.Array:
        p = router.probabilities(matrix(v))
        best = np.argsort(-p, axis=1, kind="stable")[:, :probes].astype(np.int32)
        offsets = np.arange(len(best) + 1, dtype=np.int32) * best.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(best.ravel()))

    return vectors.withColumn("parts", parts_of("v"))


def nearest_in_block(k):
    """Nearest candidates of every query of one pair of blocks."""

    def run(queries, rows):
        ids, x = rows["id"].to_numpy(), matrix(rows["v"])
        qids, q = queries["id"].to_numpy(), matrix(queries["v"])
        out = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if len(ids) and len(qids):
            # of equal vectors, the k + 1 smallest ids can be among the nearest others
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            group = np.unique(x, axis=0, return_inverse=True)[1].ravel()
            by_group = np.argsort(group, kind="stable")
            first = np.concatenate([[True], np.diff(group[by_group]) > 0])
            rank = np.arange(len(ids)) - np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))
            keep = np.sort(by_group[rank <= k])
            ids, x = ids[keep], x[keep]
            square = (x**2).sum(1)
            for a in range(0, len(q), 256):
                part = q[a : a + 256]
                near = square[None, :] - 2 * part @ x.T + (part**2).sum(1)[:, None]
                near[ids[None, :] == qids[a : a + 256, None]] = np.inf
                edge = np.partition(near, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
                slack = 1e-9 * (1 + square.max() + (part**2).sum(1))
                for i in range(len(part)):
                    at = np.flatnonzero((near[i] <= edge[i] + slack[i]) & np.isfinite(near[i]))
                    exact = np.sqrt(((x[at] - part[i]) ** 2).sum(1))
                    best = np.lexsort((ids[at], exact))[:k]
                    out[0].append(np.full(len(best), qids[a + i]))
                    out[1].append(ids[at][best])
                    out[2].append(exact[best])
        return pa.table({"query_id": np.concatenate(out[0]), "vec_id": np.concatenate(out[1]), "score": np.concatenate(out[2])})

    return run


def search(df, is_query, k=10, settings=None, id_col="vec_id", vector_col="embedding"):
    """The k nearest rows found for every row that ``is_query`` (a condition on the id column ``id``) selects."""
    settings = settings or Settings()
    vectors = stored(usable(df, id_col, vector_col), "vectors")
    router, width = fit(vectors, settings)
    if router is None:
        return vectors.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    parts = router.w2.shape[1]
    dealt = stored(routed(vectors.where(F.size("v") == width), router, min(settings.probes, parts)), "routed")
    rows = dealt.select("id", "v", F.element_at("parts", 1).alias("part"))
    asked = dealt.where(is_query).select("id", "v", F.explode("parts").alias("part"))
    # one count per part: the number of blocks that its rows and queries are cut into
    n_rows = {r["part"]: -(-r["count"] // settings.block_rows) for r in rows.groupBy("part").count().collect()}
    n_asked = {r["part"]: -(-r["count"] // settings.block_queries) for r in asked.groupBy("part").count().collect()}

    def blocks(counts):
        return F.element_at(F.create_map(*[F.lit(x) for p in range(parts) for x in (p, max(1, counts.get(p, 1)))]), F.col("part"))

    def every(counts):
        return F.explode(F.sequence(F.lit(0), blocks(counts) - 1))

    spread = F.xxhash64("id")
    rows = rows.withColumn("block", F.pmod(spread, blocks(n_rows)).cast("int")).withColumn("turn", every(n_asked))
    asked = asked.withColumn("turn", F.pmod(spread, blocks(n_asked)).cast("int")).withColumn("block", every(n_rows))
    keys = ("part", "block", "turn")
    found = asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(nearest_in_block(k), "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
