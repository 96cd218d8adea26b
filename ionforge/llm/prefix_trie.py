"""Prefix trie of conversations: which beginnings they share, and what sharing them would save.

1. Distinct turns (role and text) get a number each, in the order of role and
   text; conversations become sequences of these numbers.
2. Equal sequences are one sequence with a number of members. Their members are
   first gathered into short runs by a sort over (sequence, id), so a
   conversation that a third of all rows repeat is spread over the tasks; the
   digest over its ids, sequential by its nature, streams over these runs.
3. Distinct sequences are dealt into range shards. Each shard builds a ternary
   search tree over the numbers, balanced by inserting medians first, and one
   iterative pass from the last node made to the first adds up members, leaves
   and savings.
4. A node crosses a shard's edge only if the neighbour's nearest sequence starts
   with it. Such boundary nodes are counted as new by the first shard that has
   them, so all of a node's sums are sums over shards, merged by one grouping.

Defined results: rows without a conversation id take no part; null role or text
counts as empty; turns are ordered by their number (null first), then role and
text; repeated rows are turns of their own; texts of any length count whole; a
conversation without turns is a member of the root; an empty table has no
nodes, not even a root. Only id, turn, role and text are read, so other columns
can't clash. The numbers of one conversation's turns (8 bytes each) and one
shard must fit into a task; texts and members needn't.
"""

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import Window

from ionforge.session import stored

#: Conversation ids in one run of members.
RUN_IDS = 256
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")


def turn_digest(role, text):
    """Identity of a turn: SHA-256 over the role's length, the role and the text."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def clean(conversations):
    """Conversation id, turn, role and text without nulls but in ``turn``."""
    def filled(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)

    return conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", filled("role"), filled("text"))


def dictionary(turns):
    """Number, digest and code points of every distinct turn; numbers rise with role and text."""
    distinct = turns.groupBy("role", "text").agg(F.lit(0).alias("__one")).drop("__one")
    ordered = distinct.repartitionByRange("role", "text").sortWithinPartitions("role", "text")
    return ordered.select(F.monotonically_increasing_id().alias("turn_id"), turn_digest(F.col("role"), F.col("text")).alias("digest"), F.length("text").cast("long").alias("points"))


def sequences(conversations):
    """Every conversation's turns in order: id, array of (turn, turn_id, points)."""
    turns = clean(conversations)
    numbered = stored(dictionary(turns), "turns")
    rows = turns.select("conv_id", "turn", turn_digest(F.col("role"), F.col("text")).alias("digest")).join(numbered, "digest")
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "turn_id", "points"))).alias("turns"))


def regrown(found, block=100, most=6):
    """Give conversations the first turns of the one that leads their block of ids.

    The first ``crc32(id) % most`` turns come from conversation id - id % block
    (all it has if fewer, none if there is no such conversation); the rest are
    the conversation's own after as many.
    """
    leads = found.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("lead"), F.slice("turns", 1, most - 1).alias("head"))
    joined = found.join(leads, F.col("conv_id") - F.col("conv_id") % block == F.col("lead"), "left")
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return joined.select("conv_id", F.concat(F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), h)).otherwise(F.slice("turns", 1, 0)), own).alias("turns"))


def member_runs(rows):
    """Runs of at most ``RUN_IDS`` members of equal sequences, in order of sequence and id."""
    def run(batches):
        now, ids, found = None, [], []

        def closed():
            return {"ids": now[0], "points": now[1], "first": ids[0], "n": len(ids), "members": ",".join(map(str, ids))}

        for batch in batches:
            for sequence, points, conv in zip(*(batch.column(c).to_pylist() for c in ("ids", "points", "conv_id"))):
                if now is not None and (sequence != now[0] or len(ids) == RUN_IDS):
                    found.append(closed())
                    ids = []
                now = (sequence, points)
                ids.append(conv)
            yield pa.RecordBatch.from_pylist(found, schema)
            found = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([closed()], schema)

    schema = pa.schema([("ids", pa.list_(pa.int64())), ("points", pa.list_(pa.int64())), ("first", pa.int64()), ("n", pa.int64()), ("members", pa.string())])
    ordered = rows.repartitionByRange("ids", "conv_id").sortWithinPartitions("ids", "conv_id")
    return ordered.mapInArrow(run, "ids array<long>, points array<long>, first long, n long, members string")


def shards(runs):
    """Distinct sequences in range shards: shard, ids, points, smallest member, members, digest over all members."""
    def run(batches):
        shard, now, digest, found = TaskContext.get().partitionId(), None, None, []

        def closed():
            return now | {"ends_sha256": digest.hexdigest()}

        for batch in batches:
            for sequence, points, first, n, members in zip(*(batch.column(c).to_pylist() for c in ("ids", "points", "first", "n", "members"))):
                if now is not None and sequence == now["ids"]:
                    now["n"] += n
                    digest.update(b"," + members.encode())
                    continue
                if now is not None:
                    found.append(closed())
                now = {"shard": shard, "ids": sequence, "points": points, "low": first, "n": n}
                digest = hashlib.sha256(members.encode())
            yield pa.RecordBatch.from_pylist(found, schema)
            found = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([closed()], schema)

    schema = pa.schema([("shard", pa.int64()), ("ids", pa.list_(pa.int64())), ("points", pa.list_(pa.int64())), ("low", pa.int64()), ("n", pa.int64()), ("ends_sha256", pa.string())])
    ordered = runs.repartitionByRange("ids").sortWithinPartitions("ids", "first")
    return ordered.mapInArrow(run, "shard long, ids array<long>, points array<long>, low long, n long, ends_sha256 string")


def common_prefix(a, b):
    """Column: how many leading entries two arrays share; -1 if one of them is null."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    end = F.array_position(same, False)
    return F.when(a.isNull() | b.isNull(), -1).otherwise(F.when(end > 0, end - 1).otherwise(F.size(same))).cast("int")


def edges(dealt):
    """Per shard: the depth down to which its first path is also the shard's before, and its last path the next one's."""
    ends = dealt.groupBy("shard").agg(F.min("ids").alias("first"), F.max("ids").alias("last"))
    order = Window.orderBy("shard")  # one row per shard, that is per task
    return ends.select(
        "shard", common_prefix(F.lag("last").over(order), F.col("first")).alias("before"),
        common_prefix(F.col("last"), F.lead("first").over(order)).alias("after"),
    )


class Tree:
    """Ternary search tree over sequences of numbers. Node 0 is the root of the trie; every other node is the end of a prefix."""

    def __init__(self):
        self.symbol, self.points, self.parent, self.depth = [None], [0], [-1], [0]
        self.less, self.more, self.inner = [-1], [-1], [-1]

    def made(self, symbol, points, parent):
        self.symbol.append(symbol)
        self.points.append(points)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.less.append(-1)
        self.more.append(-1)
        self.inner.append(-1)
        return len(self.symbol) - 1

    def insert(self, ids, points):
        """The nodes of a sequence's prefixes, the root first."""
        at, path = 0, [0]
        for symbol, length in zip(ids, points):
            node = self.inner[at]
            if node < 0:
                node = self.inner[at] = self.made(symbol, length, at)
            else:
                while symbol != (here := self.symbol[node]):
                    side = self.less if symbol < here else self.more
                    if side[node] < 0:
                        side[node] = self.made(symbol, length, at)
                    node = side[node]
            path.append(node)
            at = node
        return path


def built(ids, points):
    """A tree of sorted distinct sequences, medians first; the node that each ends in, and the paths of the first and the last."""
    tree, ends, paths, todo = Tree(), [0] * len(ids), {}, [(0, len(ids))]
    while todo:
        low, high = todo.pop()
        if low < high:
            middle = (low + high) // 2
            path = tree.insert(ids[middle], points[middle])
            ends[middle] = path[-1]
            if middle in (0, len(ids) - 1):
                paths[middle] = path
            todo += [(low, middle), (middle + 1, high)]
    return tree, ends, paths[0], paths[len(ids) - 1]


def prefix_keys(ids, depth):
    """Digests of a sequence's prefixes from the empty one down to a depth."""
    digest = hashlib.blake2b(digest_size=16)
    keys = [digest.hexdigest()]
    for number in ids[:depth]:
        digest.update(number.to_bytes(8, "big"))
        keys.append(digest.hexdigest())
    return keys


def shard_nodes(rows, before, after):
    """Nodes of one shard. Boundary nodes have a key, and what they hold is this shard's part of their sums."""
    rows = sorted(rows, key=lambda r: r["ids"])
    ids = [r["ids"] for r in rows]
    tree, ends, first, last = built(ids, [r["points"] for r in rows])
    count = len(tree.symbol)
    members, low, digest = [0] * count, [None] * count, [None] * count
    for node, row in zip(ends, rows):
        members[node], low[node], digest[node] = row["n"], row["low"], row["ends_sha256"]
    key = dict(zip(first[: before + 1], prefix_keys(ids[0], before))) if before >= 0 else {}
    earlier = set(key)
    if after >= 0:
        key |= dict(zip(last[: after + 1], prefix_keys(ids[-1], after)))
    children, leaves, saved = [0] * count, [0] * count, [0] * count
    for node in range(count - 1, -1, -1):  # a node is made after its parent
        new = node not in earlier
        if not children[node] and new and tree.inner[node] < 0 and not (node == last[-1] and after == len(ids[-1])):
            leaves[node] = 1
        saved[node] += (members[node] - new) * tree.points[node]
        above = tree.parent[node]
        if above >= 0:
            members[above] += members[node]
            low[above] = low[node] if low[above] is None else min(low[above], low[node])
            children[above] += new
            leaves[above] += leaves[node]
            saved[above] += saved[node]
    for node in range(count):
        above = tree.parent[node]
        yield {
            "key": key.get(node), "parent_key": key.get(above), "conv_id": low[node], "depth": tree.depth[node],
            "parent_conv_id": None if above < 0 or above in key else low[above], "turn_id": tree.symbol[node],
            "n_convs": members[node], "n_children": children[node], "n_leaves": leaves[node], "saved_tokens": saved[node], "ends_sha256": digest[node],
        }


def nodes(dealt):
    """All nodes of the trie over distinct sequences in stored shards."""
    schema = pa.schema([
        ("key", pa.string()), ("parent_key", pa.string()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
        ("turn_id", pa.int64()), *[(c, pa.int64()) for c in SUMS], ("ends_sha256", pa.string()),
    ])

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        return pa.Table.from_pylist(list(shard_nodes(rows, rows[0]["before"], rows[0]["after"])), schema)

    known = dealt.join(F.broadcast(edges(dealt)), "shard")  # one row of three numbers per shard
    found = stored(known.groupBy("shard").applyInArrow(run, ", ".join(f"{f.name} {'string' if pa.types.is_string(f.type) else 'long'}" for f in schema)), "trie-parts")
    inner = found.where(F.col("key").isNull()).drop("key")
    boundary = found.where(F.col("key").isNotNull()).groupBy("key", "parent_key", "depth", "turn_id").agg(
        F.min("conv_id").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), *[F.sum(c).alias(c) for c in SUMS], F.max("ends_sha256").alias("ends_sha256"))
    boundary = stored(boundary, "trie-boundary")
    every = inner.unionByName(boundary.drop("key"))
    names = boundary.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    lone = every.where(F.col("parent_key").isNull()).withColumn("above", F.lit(None).cast("long"))
    every = lone.unionByName(every.where(F.col("parent_key").isNotNull()).join(names, "parent_key"))
    return every.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "above").alias("parent_conv_id"), *SUMS,
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"), "turn_id",
    )


def trie(found):
    """Nodes of the prefix trie of sequences (conv_id, turns)."""
    rows = stored(found.select("conv_id", F.col("turns.turn_id").alias("ids"), F.col("turns.points").alias("points")), "sequences")
    return nodes(stored(shards(stored(member_runs(rows), "member-runs")), "trie-shards"))
