"""Near-duplicate documents: pairs by shared shingles, ordered by SimHash, checked by Jaccard similarity.

Two texts are near-duplicates when their sets of five-word shingles (A-Z in
lower case) have a Jaccard similarity of 0.8 or more. Pairs are brought
together by shared shingles, and the shingle sets alone decide:

1. every text is known by a digest of its shingle set; its keys are its
   ``keys`` smallest shingle hashes. A pair at 0.8 shares none of 12 with a
   probability below 1e-8;
2. shingles that at least ``hot_share`` of all documents hold (common passages)
   are taken last, so they don't fill cells; there are at most 1 / hot_share
   times the mean number of shingles of them. Texts that consist of them by
   half or more use them as well;
3. a key's rows are cut by set size and sorted by it. A pair is discarded only
   where it can't reach the similarity: its sizes differ too much, or more of
   512 parities of the sets differ than shingles of similar sets can;
4. the pivot tables of ``simhash.links`` bring together sets whose fingerprints
   differ in 3 bits at most; they are compared in the first round;
5. cells of more than ``block_rows`` rows are cut into blocks by hash; once
   copies have one root, the rows of other roots visit every block, or, where
   they are the greater part, every pair of blocks is a group of its own;
6. a cell of many pairs reports forests of the pairs of different roots, those
   of least SimHash distance first. Their shingle sets are compared, roots
   joined, and cells with more pairs take part again, until every pair of
   different roots that share a key has been compared.

Defined results: null text counts as empty; texts without words are one group;
shorter texts use their whole sequence of words; texts with equal shingle sets are
one group; the row with the smallest id of a group stays, a null id only where
a group has no other; of rows with that id one stays; an empty table gives an
empty result; all columns of the input stay, working columns are private.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import functions as F

from ionforge.llm.common import rowed
from ionforge.llm.simhash import DISTANCE, SEED, WORDS, components, links
from ionforge.session import stored


@dataclass
class Settings:
    size: int = 5
    similarity: float = 0.8
    keys: int = 12
    hot_share: float = 0.001
    forests: int = 1  # of a cell that are verified in the first round
    block_rows: int = 1024
    link_share: int = 3
    slots: int = 1 << 22
    chunk: int = 2_000_000  # shingles that a task counts at a time


def shingle_hashes(text, size):
    """Sorted distinct hashes of a lower-cased text's shingles."""
    words = WORDS.findall(text)
    if not words:
        return np.empty(0, np.uint64)
    count = max(len(words) - size + 1, 1)
    hashes = (xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), SEED) for i in range(count))
    return np.unique(np.fromiter(hashes, np.uint64, count))


def lower_bytes(texts):
    """The texts of an Arrow column with A-Z in lower case as bytes, one after another."""
    return (t.as_py() for t in pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.binary()))


def majority_of(hashes):
    """SimHash of a set of hashes; zero for the empty set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def digest(hashes):
    """Digest of a set of sorted hashes as a signed long; zero for the empty set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes(), SEED) if len(hashes) else 0).view(np.int64))


def parities(hashes):
    """Whether a set has an odd number of hashes in each of 512 classes, as bytes."""
    return np.packbits(np.bincount((hashes & np.uint64(511)).view(np.int64), minlength=512) & 1).tobytes()


def frequent(docs, settings):
    """Sorted hashes of the shingles that many documents hold.

    Each task counts its own share; what is frequent over all is frequent in
    some share, so only that is summed. The list only orders keys.
    """
    size, share, chunk = settings.size, settings.hot_share, settings.chunk

    def count(batches):
        pending, held, rows = [], 0, 0

        def found():
            values, times = np.unique(np.concatenate(pending), return_counts=True)
            many = times >= max(2, share * rows)
            return pa.RecordBatch.from_arrays([pa.array(values[many].view(np.int64)), pa.array(times[many])], ["shingle", "n"])

        for batch in batches:
            for text in lower_bytes(batch["text"]):
                pending.append(shingle_hashes(text, size))
                held, rows = held + len(pending[-1]), rows + 1
                if held >= chunk:
                    yield found()
                    pending, held, rows = [], 0, 0
        if pending:
            yield found()

    counted = docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    least = settings.hot_share * docs.count()
    # at most 1 / hot_share times the mean number of shingles
    hot = counted.where(F.col("n") >= least).select("shingle").toPandas()["shingle"].to_numpy(np.int64)
    return np.sort(hot.view(np.uint64))


def chosen_keys(hashes, hot, most):
    """The smallest hashes that aren't frequent, and the smallest frequent ones of texts made of them by half or more."""
    is_hot = np.isin(hashes, hot, assume_unique=True)
    picked = hashes[~is_hot][:most]
    if 2 * is_hot.sum() >= len(hashes):
        picked = np.concatenate([picked, hashes[is_hot][:most]])
    return picked


def text_digest(text):
    """128 bits that tell a text from others; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def sketches(docs, settings, hot):
    """Id, set digest, fingerprint, parities, number of shingles and keys of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    size, most = settings.size, settings.keys
    kind = pa.struct([("node", pa.int64()), ("fp", pa.int64()), ("bits", pa.binary()), ("n", pa.int32()), ("keys", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<node: long, fp: long, bits: binary, n: int, keys: array<long>>")
    def of(body: pa.Array) -> pa.Array:
        rows = []
        for text in lower_bytes(body):
            hashes = shingle_hashes(text, size)
            fp = np.array([majority_of(hashes)], np.uint64).view(np.int64)[0]
            rows.append({"node": digest(hashes), "fp": int(fp), "bits": parities(hashes), "n": len(hashes), "keys": chosen_keys(hashes, shared.value, most).view(np.int64).tolist()})
        return pa.array(rows, kind)

    return docs.select("doc_id", text_digest(F.col("text")).alias("text_id"), of(F.col("text")).alias("s")).select("doc_id", "text_id", "s.*")


def cells(prints, similarity):
    """Every set under its keys, by ranges of set sizes; rows near a lower edge are shown to the range below as well."""
    one = prints.groupBy("node").agg(F.max("n").alias("n"), F.max("fp").alias("fp"), F.max("bits").alias("bits"), F.max("keys").alias("keys")).where("n > 0")
    rows = one.select("node", "n", "fp", "bits", F.explode("keys").alias("key"))
    home = F.floor(F.log(4.0, F.col("n"))).cast("int")
    below = F.floor(F.log(4.0, F.col("n") * similarity - 1e-6)).cast("int")
    places = F.array_distinct(F.array(F.struct(home.alias("range"), F.lit(False).alias("shown")), F.struct(below.alias("range"), (below < home).alias("shown"))))
    return rows.withColumn("place", F.explode(places)).select("key", "place.range", "place.shown", "n", "fp", "bits", "node")


def least_forest(a, b, d):
    """Numbers of the pairs of a spanning forest that takes pairs of smaller distance first."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    order = np.lexsort((at[len(a) :], at[: len(a)], d))
    u, v = at[: len(a)][order], at[len(a) :][order]
    own, keep, left = np.arange(len(nodes)), np.zeros(len(a), bool), np.arange(len(a))
    label = own
    while True:  # every tree takes its first pair to another tree
        x, y = label[u[left]], label[v[left]]
        apart = x != y
        left, x, y = left[apart], x[apart], y[apart]
        if not len(left):
            return order[keep]
        first = np.full(len(nodes), len(a))
        np.minimum.at(first, x, left)
        np.minimum.at(first, y, left)
        trees = np.flatnonzero(first < len(a))
        pair = first[trees]
        keep[pair] = True
        up = own.copy()
        up[trees] = label[u[pair]] + label[v[pair]] - trees
        both = (up[up] == own) & (own < up)
        up[both] = own[both]
        while (up[up] != up).any():
            up = up[up]
        label = up[label]


def forests_at(a, b, d, count):
    """Numbers of the pairs of ``count`` forests, each of what the ones before left over."""
    left, taken = np.arange(len(a)), []
    for _ in range(count):
        if not len(left):
            break
        picked = least_forest(a[left], b[left], d[left])
        taken.append(left[picked])
        left = np.delete(left, picked)
    return np.concatenate(taken) if taken else left


def least_forests(a, b, d, count):
    """The pairs of ``count`` forests, each of what the ones before left over."""
    taken = forests_at(a, b, d, count)
    return a[taken], b[taken], d[taken]


GROUP = ("key", "range", "i", "j")
ROW = "key long, range int, i int, j int, side boolean, linking boolean, shown boolean, n int, fp long, bits binary, node long"


def whole_groups(batches, most=4096):
    """Sorted batches as tables of whole groups and the number of each row's group, of little more than ``most`` rows."""

    def numbers(rows):
        change = np.zeros(rows.num_rows, bool)
        for name in GROUP:
            x = rows[name].to_numpy()
            change[1:] |= x[1:] != x[:-1]
        return np.cumsum(change)

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        group = numbers(rows)
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        at, last = 0, starts[-1]
        while at < last:
            end = min(starts[min(np.searchsorted(starts, at + most), len(starts) - 1)], last)
            yield rows.slice(at, end - at), group[at:end] - group[at]
            at = end
        held = rows.slice(last)
    if held is not None:
        yield held, np.zeros(held.num_rows, np.int64)


def close_pairs(rows, cell, root, settings):
    """Row numbers of the pairs of different roots in a cell that sizes and bits allow; no pair of similar sets is left out.

    Sets that differ in few shingles differ in as many bits of their parities at most.
    """
    n, shown, side, linking = (rows[c].to_numpy() for c in ("n", "shown", "side", "linking"))
    inner = rows["i"].to_numpy() == rows["j"].to_numpy()
    bits = np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint64).reshape(len(n), -1)
    most = (1 - settings.similarity) / (1 + settings.similarity)
    found, at, step = [], np.arange(len(n) - 1), 1
    while len(at):
        at = at[at + step < len(n)]
        at = at[(cell[at] == cell[at + step]) & (n[at] >= settings.similarity * n[at + step] - 1e-6)]
        other = at + step
        fine = (root[at] != root[other]) & ~(shown[at] & shown[other]) & (inner[at] | (side[at] != side[other]))
        i, j = at[fine], other[fine]
        near = np.bitwise_count(bits[i] ^ bits[j]).sum(1) <= most * (n[i] + n[j]) + 1e-6
        found.append(np.stack([i[near], j[near]]))
        at = at[~linking[at]]  # those are only compared with the next row
        step += 1
    return np.concatenate(found, 1) if found else np.empty((2, 0), np.int64)


def reported(rows, cell, settings, count):
    """Pairs to verify and the rows of cells that hold more: all pairs of a cell if they are few, or ``count`` forests of its roots."""
    root, node, fp = rows["root"].to_numpy(), rows["node"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)
    i, j = close_pairs(rows, cell, root, settings)
    pairs, members = np.bincount(cell[i], minlength=cell[-1] + 1), np.bincount(cell)
    many = pairs > count * members
    if many.any():
        roots, at = np.unique(root, return_inverse=True)
        tree = cell * len(roots) + at
        inside = many[cell[i]]
        a, b = i[inside], j[inside]
        taken = forests_at(tree[a], tree[b], np.bitwise_count(fp[a] ^ fp[b]).astype(np.int64), count)
        i, j = np.concatenate([i[~inside], a[taken]]), np.concatenate([j[~inside], b[taken]])
        many &= pairs > np.bincount(cell[i], minlength=cell[-1] + 1)
    u, v = np.maximum(node[i], node[j]), np.minimum(node[i], node[j])
    return np.unique(np.stack([u, v]), axis=1), many[cell]


def candidates(rows, settings, count):
    """Pairs of sets to compare (u > v), and with null pairs the rows of groups that hold more pairs than reported."""
    names = [x.split()[0] for x in ROW.split(", ")]

    def run(batches):
        for part, cell in whole_groups(batches):
            (u, v), more = reported(part, cell, settings, count)
            own = part.select(names)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), *(pa.nulls(len(u), k) for k in own.schema.types)], ["u", "v", *names])
            if more.any():
                own = own.filter(pa.array(more)).combine_chunks()
                none = pa.nulls(own.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, *(c.combine_chunks() for c in own.columns)], ["u", "v", *names])

    dealt = rows.repartition(*GROUP).sortWithinPartitions(*GROUP, "n", "fp", "node")
    return dealt.mapInArrow(run, f"u long, v long, {ROW}")


def shingle_sets(docs, nodes, settings):
    """The shingle sets of the given nodes; a table of ``slots`` bits tells most other texts before the shuffle."""
    size, slots = settings.size, settings.slots
    marked = np.zeros(slots, bool)
    marked[nodes.select(F.pmod("node", F.lit(slots)).cast("int").alias("slot")).distinct().toPandas()["slot"].to_numpy(np.int64)] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(marked))

    def run(batches):
        asked = np.unpackbits(shared.value)
        for batch in batches:
            found = {}
            for text in lower_bytes(batch["text"]):
                hashes = shingle_hashes(text, size)
                node = digest(hashes)
                if asked[node % slots]:
                    found[node] = hashes.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.list_(pa.int64()))], ["node", "set"])

    return docs.select("text").mapInArrow(run, "node long, set array<long>").groupBy("node").agg(F.any_value("set").alias("set"))


def verified(sets, pairs, settings):
    """The pairs whose shingle sets are similar enough."""
    a = sets.select(F.col("node").alias("u"), F.col("set").alias("a"))
    b = sets.select(F.col("node").alias("v"), F.col("set").alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    both = pairs.join(a, "u").join(b, "v")
    return both.where(common >= settings.similarity * (F.size("a") + F.size("b") - common)).select("u", "v")


def simhash_pairs(prints):
    """Pairs of sets (u > v) that SimHash brings together: fingerprints found by the pivot tables of ``simhash.links``, or equal ones."""
    own = prints.where("n > 0").select("fp", "node").distinct()
    first = stored(own.groupBy("fp").agg(F.min("node").alias("first")), "near-prints")
    equal = own.join(first, "fp").where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    near = links(first.select("fp"), DISTANCE).withColumnsRenamed({"u": "a", "v": "b"})
    for side, end in (("a", "u"), ("b", "v")):
        near = near.join(first.select(F.col("fp").alias(side), F.col("first").alias(end)), side)
    return equal.unionByName(near.select("u", "v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def with_roots(rows, roots):
    """Rows of sets with the root of each, itself where it has none."""
    return rows.join(roots.withColumnRenamed("fp", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))


def dealt_blocks(within, roots, settings):
    """The rows of large cells that still hold several roots, in groups where every pair of different roots meets.

    Of such a pair one row at least isn't of the cell's largest root. Where few
    rows aren't, these visit every block, and the others stay in theirs, so a
    family of copies costs its size. Else every pair of blocks is a group.
    """
    zero, no, yes = F.lit(0), F.lit(False), F.lit(True)
    spread = F.xxhash64("node", "key")
    cell = ["key", "range"]
    of_rows = with_roots(within, roots)
    sizes = of_rows.groupBy(*cell, "root").agg(F.count("*").alias("rows"))
    most = sizes.groupBy(*cell).agg(F.sum("rows").alias("all"), F.max(F.struct("rows", "root")).alias("most"))
    open_cells = stored(most.where(F.col("all") > F.col("most.rows")).select(*cell, F.col("most.root").alias("main"), (F.col("all") - F.col("most.rows")).alias("rest"), "all"), "near-open")
    dealt = of_rows.join(open_cells, cell).withColumn("own", F.pmod(spread, F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("teams", F.ceil(F.col("rest") / settings.block_rows).cast("int")).withColumn("few", 2 * F.col("rest") <= F.col("all"))
    # residents of block i meet one another, and every team j of visitors
    team = F.pmod(F.xxhash64("key", "node", F.lit(1)), F.col("teams")).cast("int")
    place = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.alias("side"))
    own, blocks = F.col("own"), F.col("blocks")
    stay = F.concat(F.array(place(own, own, no)), F.transform(F.sequence(zero, F.col("teams") - 1), lambda t: place(own, blocks + t, no)))
    visit = F.when(F.col("root") == F.col("main"), F.array().cast("array<struct<i:int,j:int,side:boolean>>")).otherwise(
        F.transform(F.sequence(zero, blocks - 1), lambda b: place(b, blocks + team, yes)))
    pairs = F.transform(F.sequence(zero, blocks - 1), lambda b: place(F.least(own, b), F.greatest(own, b), own > b))
    dealt = dealt.withColumn("at", F.explode(F.when(F.col("few"), F.concat(stay, visit)).otherwise(pairs)))
    return dealt.withColumn("linking", no).select(*cell, "shown", "n", "fp", "bits", "node", "root", "at.i", "at.j", "at.side", "linking")


def linked(docs, prints, settings):
    """The root of every set that has near-duplicates (columns fp, root).

    Cells of more than ``block_rows`` rows are first thinned: every row is
    compared with its next one in about a third of such cells, so a family of
    copies becomes one root. Then all their pairs of different roots are
    compared, block by block. A round reports forests of the pairs of
    different roots, verifies them and joins roots; cells that hold more pairs
    take part again with more forests, until all pairs of different roots have
    been verified.
    """
    placed = cells(prints, settings.similarity)
    counted = placed.groupBy("key", "range").agg(F.count("*").alias("rows")).where(F.col("rows") > settings.block_rows)
    blocks = F.ceil(F.col("rows") / settings.block_rows).cast("int").alias("blocks")
    large = stored(counted.select("key", "range", blocks), "near-large")  # at most keys / block_rows of the number of rows
    spread = F.xxhash64("node", "key")
    zero, no = F.lit(0), F.lit(False)
    rows = placed.join(large, ["key", "range"], "left_anti").withColumns({"i": zero, "j": zero, "side": no, "linking": no})
    within = placed.join(large, ["key", "range"])
    cut = not large.isEmpty()
    if cut:
        at = F.pmod(spread, F.col("blocks") * settings.link_share).cast("int")
        chain = within.withColumn("i", at).where("i < blocks").withColumns({"j": F.col("i"), "side": no, "linking": F.lit(True)}).drop("blocks")
        rows = rows.unionByName(chain)
    roots = similar = tested = sets = None
    count = settings.forests
    rows = rows.withColumn("root", F.col("node"))
    while True:
        found = stored(candidates(rows, settings, count), "near-candidates")
        pairs = found.where("u IS NOT NULL").select("u", "v")
        pairs = (pairs.unionByName(simhash_pairs(prints)) if tested is None else pairs).distinct()
        pairs = stored(pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti"), "near-pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        if sets is None:  # later rounds have no other nodes: a forest takes every node that has a pair
            nodes = pairs.select(F.explode(F.array("u", "v")).alias("node"))
            sets = stored(shingle_sets(docs, nodes.unionByName(within.select("node")) if cut else nodes, settings), "near-sets")
        near = stored(verified(sets, pairs, settings), "near-links")
        similar = near if similar is None else similar.unionByName(near)
        roots = stored(components(similar), "near-roots")
        rows = with_roots(found.where("u IS NULL AND NOT linking").drop("u", "v"), roots)
        if cut:
            rows, cut = rows.unionByName(dealt_blocks(within, roots, settings)), False
        if rows.isEmpty():
            return roots
        count *= 4


def deduplicate(docs, settings=None):
    """The documents that stay, one of each group, with all their columns."""
    settings = settings or Settings()
    prints = stored(sketches(docs, settings, frequent(docs, settings)), "near-sketches")
    roots = linked(docs, prints, settings).withColumnRenamed("fp", "node")
    by_row = prints.groupBy("node", "doc_id", "text_id").agg(F.count("*").alias("copies"))
    rooted = by_row.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # the smallest id, nulls last; of its texts the smallest digest
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_id", "copies")).alias("s")
    stay = stored(rooted.groupBy("root").agg(first).select(F.col("s.doc_id").alias("near_id"), F.col("s.text_id").alias("near_text"), F.col("s.copies").alias("copies")), "near-stay")
    rows = rowed(docs, id=F.col("doc_id"), text_id=text_digest(F.col("text")))

    def staying(chosen):
        return rows.join(chosen, F.col("id").eqNullSafe(F.col("near_id")) & (F.col("text_id") == F.col("near_text")), "left_semi")

    one_each = staying(stay.where("copies > 1")).dropDuplicates(["id", "text_id"])
    return staying(stay.where("copies = 1")).unionByName(one_each).select("row.*")
