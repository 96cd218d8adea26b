"""Connected components over rows that share any token (record, host, endpoint id).

Nodes are tokens, not rows: a row contributes edges between its own tokens
only. In a round every task joins the edges it holds by union-find and keeps a
star per component: each node with its local root, the node of smallest random
priority. One grouping by node then shows which nodes have several roots: they
link these roots, which are the edges of the next round. A node that is no root
anywhere leaves the graph, so nodes shrink by a constant share at least, and
edges that fit into one task are settled in one round. A hub has one row per
task, however many edges it has. Every round is written to the shared folder,
so a lost executor never replays earlier rounds.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ionforge.operators.skew import attach_stored
from ionforge.session import stored

MAX_ROUNDS = 60
#: Edges that a task joins at a time.
CHUNK = 1_000_000


def row_tokens(rows, kinds):
    """Array of namespaced, non-empty tokens per row, e.g. ``endpoint:mp-1``."""
    parts = [F.when(F.coalesce(F.col(c) != "", F.lit(False)), F.concat(F.lit(f"{kind}:"), F.col(c))) for kind, c in kinds]
    return F.array_compact(F.array(*parts))


def local_roots(u, v, count):
    """For nodes 0..count-1 the smallest node that the edges u-v connect each of them to."""
    root = np.arange(count)
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def local_stars(edges, turn):
    """Every node of a task's edges with its root there (a root with itself); columns ``x, root``."""
    def star(batches):
        held = pa.Table.from_batches(batches)
        ends = pa.concat_arrays([c for name in ("u", "v") for c in held.column(name).chunks]).dictionary_encode()
        rank = pa.concat_arrays([c for name in ("pu", "pv") for c in held.column(name).chunks]).to_numpy()
        names, code = ends.dictionary, ends.indices.to_numpy()
        priority = np.empty(len(names), np.int64)
        priority[code] = rank
        order = np.argsort(priority, kind="stable")
        number = np.empty(len(names), np.int64)
        number[order] = np.arange(len(names))
        node = number[code]
        root = local_roots(node[: len(node) // 2], node[len(node) // 2 :], len(names))
        ordered = names.take(pa.array(order))
        return pa.RecordBatch.from_arrays([ordered, ordered.take(pa.array(root))], ["x", "root"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held, size = held + [batch], size + batch.num_rows
            if size >= CHUNK:
                yield star(held)
                held, size = [], 0
        if size:
            yield star(held)

    ranked = edges.select("u", "v", F.xxhash64(F.lit(turn), "u").alias("pu"), F.xxhash64(F.lit(turn), "v").alias("pv"))
    return ranked.mapInArrow(run, "x string, root string")


def joined_round(edges, turn):
    """Per node: the best of its roots, all of them (one per task at most), and whether it is a root itself."""
    key = F.struct(F.xxhash64(F.lit(turn), "root").alias("p"), "root")
    stars = local_stars(edges, turn).groupBy("x").agg(F.min(key)["root"].alias("label"), F.collect_set("root").alias("roots"), F.max(F.col("x") == F.col("root")).alias("is_root"))
    return stored(stars, "stars")


def token_components(edges):
    """Representative of every token that isn't one: columns ``token``, ``rep``, and the number of rounds."""
    rounds, edges = [], edges.where("u <> v").select("u", "v")
    while True:
        if len(rounds) == MAX_ROUNDS:
            raise RuntimeError("component contraction did not converge")
        found = joined_round(edges, len(rounds))
        rounds.append(found.where(~F.col("is_root")).select("x", "label"))
        open_ = found.where(F.size("roots") > 1)
        if open_.isEmpty():
            break
        # spread by node, and packed into as few tasks as the adaptive planner finds enough
        edges = open_.select(F.col("label").alias("u"), F.explode("roots").alias("v")).where("u <> v").repartition("v")
    final = rounds[-1]
    for labels in reversed(rounds[:-1]):
        # Many tokens may point at one label, so the lookup is balanced by label frequency.
        size = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        step = stored(size.join(final.select(F.col("x").alias("label"), F.col("label").alias("next")), "label"), "labels")
        resolved = attach_stored(labels, step, ["label"], ["next"], ["x"]).select("x", F.coalesce("next", "label").alias("label"))
        final = stored(resolved.unionByName(final), "resolved")
    return final.select(F.col("x").alias("token"), F.col("label").alias("rep")), len(rounds)


def connected_groups(rows, uid, kinds, out="group_id", prefix="g_"):
    """Add the group id ``prefix + min(uid)`` of each row's component.

    ``rows`` is read several times and should be a stored table.
    """
    rows = rows.withColumn("__tokens", row_tokens(rows, kinds))
    pairs = rows.select(F.col("__tokens")[0].alias("u"), F.explode(F.slice("__tokens", 2, len(kinds))).alias("v")) \
        if len(kinds) > 1 else rows.select(F.lit("").alias("u"), F.lit("").alias("v")).limit(0)
    reps, _ = token_components(pairs)
    rows = rows.withColumn("__token", F.get("__tokens", F.lit(0))).drop("__tokens")
    per_token = (rows.where(F.col("__token").isNotNull()).groupBy("__token")
                 .agg(F.min(uid).alias("__uid"), F.count(F.lit(1)).alias("n")))
    per_token = per_token.join(reps.withColumnRenamed("token", "__token"), "__token", "left")
    per_token = per_token.withColumn("__rep", F.coalesce("rep", "__token")).drop("rep")
    per_token = stored(per_token, "tokens")
    smallest = stored(per_token.groupBy("__rep").agg(F.min("__uid").alias("__min"), F.count(F.lit(1)).alias("n")), "smallest")
    labelled = attach_stored(per_token.withColumnRenamed("n", "__rows"), smallest, ["__rep"], ["__min"], ["__token"])
    table = stored(labelled.select("__token", "__min", F.col("__rows").alias("n")), "token-groups")
    found = attach_stored(rows, table, ["__token"], ["__min"], [uid])
    return found.withColumn(out, F.concat(F.lit(prefix), F.coalesce("__min", F.col(uid)))).drop("__token", "__min")


def group_stats(rows, group="group_id"):
    """Number of components and the size of the largest one."""
    return (rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
            .agg(F.count(F.lit(1)).alias("groups"), F.max("n").alias("largest_group_rows")))
