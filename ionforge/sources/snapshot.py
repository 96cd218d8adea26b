"""Snapshot completeness: page logs, repeated pages, declared counts, versions."""

from pyspark.sql import functions as F


def page_log_gaps(pages, group):
    """Verdict per group: pages tile 0..sum(count), totals equal the final sum, counts positive.

    Every page opens a step at ``skip`` and closes it at ``skip + count``.
    With positive counts the steps form one chain from 0 to the final sum
    exactly when openings and closings balance at every offset, so no group
    has to be sorted in one task.
    """
    total = F.sum("count")
    stats = pages.groupBy(*group).agg(
        F.count(F.lit(1)).alias("pages"), total.alias("n_rows"),
        F.count_if(F.coalesce(F.col("count"), F.lit(0)) <= 0).alias("bad_counts"),
        ((F.min("total") == F.max("total")) & (F.coalesce(F.max("total"), F.lit(-1)) == total)).alias("totals_match"))
    step = lambda at, sign: F.struct(at.cast("bigint").alias("at"), F.lit(sign).alias("sign"))
    opened = pages.select(*group, F.inline(F.array(step(F.col("skip"), 1), step(F.col("skip") + F.col("count"), -1))))
    frame = stats.select(*group, F.inline(F.array(step(F.lit(0), -1), step(F.col("n_rows"), 1))))
    gaps = (opened.unionByName(frame).groupBy(*group, "at").agg(F.sum("sign").alias("balance")).where("balance <> 0")
            .groupBy(*group).agg(F.count(F.lit(1)).alias("open_offsets")))
    out = stats.join(gaps, list(group), "left").withColumn("open_offsets", F.coalesce("open_offsets", F.lit(0)))
    return out.withColumn("complete", (F.col("open_offsets") == 0) & (F.col("bad_counts") == 0) & F.col("totals_match"))


def repeated_page_check(pages, page, content, scope=()):
    """Page contents seen more than once within the scope."""
    return (pages.groupBy(*scope, F.sha2(content, 256).alias("page_hash"))
            .agg(F.count(F.lit(1)).alias("copies"), F.min(page).alias("first_page")).where("copies > 1"))


def snapshot_reconcile(actual, declared, keys, count="declared"):
    """Declared against actual row counts; a key on one side only is a mismatch."""
    counts = actual.groupBy(*keys).agg(F.count(F.lit(1)).alias("actual"))
    both = counts.join(declared, list(keys), "full_outer")
    return both.withColumn("matches", F.col("actual").eqNullSafe(F.col(count)))


def version_consistency(rows, version, group=()):
    """Whether each snapshot reports at most one database version."""
    return rows.groupBy(*group).agg((F.min(version).eqNullSafe(F.max(version))).alias("consistent"))
