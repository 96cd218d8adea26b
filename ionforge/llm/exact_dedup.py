"""Exact deduplication by 128-bit content hash with a byte comparison inside the groups.

Texts are grouped by (MD5, text): Spark deals them out by hash and compares
the bytes of equal hashes, so texts that only share a hash stay apart. Copies
are combined before the shuffle, so a text that a third of all rows share is a
few rows per task. Documents find their group again by MD5 and SHA-256; large
groups are split by the adaptive skew join.

Defined results: null text counts as empty, and all empty texts are equal; of
equal texts one row stays, that of the smallest (or largest) id; a null id
stays only if its group has no other; of several rows with the id that stays,
one is kept; an empty table gives an empty result. Working columns are private,
so any extra column stays as it is,
whatever its name.
"""

from pyspark.sql import functions as F

from ionforge.llm.common import lowered, rowed


def keyed(docs, normalise=lowered):
    """Id, normalised text and its two hashes."""
    rows = docs.select(F.col("doc_id"), normalise(F.col("text")).alias("body"))
    return rows.select("doc_id", "body", F.unhex(F.md5("body")).alias("md5"), F.sha2("body", 256).alias("sha256"))


def groups(docs, keep="smallest", normalise=lowered):
    """One row per distinct text: hashes, the id that stays and the number of rows."""
    best = F.min("doc_id") if keep == "smallest" else F.max("doc_id")
    distinct = keyed(docs, normalise).groupBy("md5", "body").agg(best.alias("keep_id"), F.count("*").alias("group_size"))
    return distinct.select("md5", F.sha2("body", 256).alias("sha256"), "keep_id", "group_size")


def decide(docs, keep="smallest", normalise=lowered):
    """One row per document: id, the id that stays, group size, whether this row stays, and the text's SHA-256."""
    found = groups(docs, keep, normalise)
    # rows that repeat an id and its text are told apart by a number
    rows = keyed(docs, normalise).groupBy("md5", "sha256", "doc_id").agg(F.count("*").alias("copies"))
    joined = rows.join(found, ["md5", "sha256"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return joined.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.col("sha256").alias("text_sha256"),
    )


def deduplicate(docs, keep="smallest", normalise=lowered):
    """The documents that stay, with all their columns."""
    stay = groups(docs, keep, normalise).select("keep_id", F.col("sha256").alias("of"))
    rows = rowed(docs, id=F.col("doc_id"), sha256=F.sha2(normalise(F.col("text")), 256))
    joined = rows.join(stay, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("sha256") == F.col("of")), "left_semi")
    return joined.dropDuplicates(["id", "sha256"]).select("row.*")
