"""Duplicate, conflict and missing-record detection by two-level aggregation."""

from pyspark.sql import functions as F

from ionforge.functions.keys import fingerprint
from ionforge.operators.skew import attach
from ionforge.session import stored


def flag_exact_duplicate_rows(rows, content_hash, position, out="exact_duplicate", base=None):
    """True for every copy after the first one in source order.

    ``base`` may name a stored table of the same rows to aggregate from.
    """
    first = (rows if base is None else base).groupBy(content_hash).agg(F.min(position).alias("__first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = attach(rows, first, [content_hash], ["__first"], [position])
    return joined.withColumn(out, F.coalesce(F.col(position) > F.col("__first"), F.lit(False))).drop("__first")


def _varies(col):
    """More than one distinct non-null value, with plain map-side aggregates."""
    return F.min(col) != F.max(col)


def flag_identity_conflict(rows, uid, content_hash, spread, out="identity_conflict", base=None):
    """True for all members of a uid whose contents differ."""
    bad = (rows if base is None else base).groupBy(uid).agg(_varies(content_hash).alias("__bad"), F.count(F.lit(1)).alias("n")).where("__bad")
    joined = attach(rows, bad, [uid], ["__bad"], spread)
    return joined.withColumn(out, F.coalesce("__bad", F.lit(False))).drop("__bad")


def resolve_metadata(records, requested, key="material_id"):
    """Requested records with one undisputed content; and issue rows for the rest.

    Returns ``(accepted, issues)``; issues are rejected (not requested),
    conflicting (several contents) or unresolved (requested, nothing accepted).
    """
    content, fp = list(records.columns), fingerprint(records, list(records.columns))
    # copies of a record collapse before the shuffle: an id is one row, however often it repeats
    one = records.select(F.col(key).alias("__key"), F.struct(*content).alias("record"), fp.alias("__fp")).groupBy("__key").agg(
        F.min_by("record", "__fp").alias("record"), _varies("__fp").alias("bad"))
    wanted = requested.where(F.col(key).isNotNull()).select(F.col(key).alias("__wanted")).distinct()
    found = stored(one.join(wanted, F.col("__key") == F.col("__wanted"), "full_outer"), "metadata")
    unknown, absent = F.col("__wanted").isNull(), F.col("record").isNull()
    kinds = F.array_compact(F.array(
        F.when(unknown, "rejected_metadata_id"), F.when(~unknown & ~absent & F.col("bad"), "conflicting_metadata"),
        F.when(~unknown & (absent | F.col("bad")), "unresolved_metadata")))
    issues = found.select(F.explode(kinds).alias("kind"), F.coalesce("__key", "__wanted").alias(key))
    return found.where(~unknown & ~absent & ~F.col("bad")).select("record.*"), issues


def missing_ids(requested, resolved, key="material_id"):
    return requested.select(key).distinct().join(resolved.select(key), key, "left_anti")
