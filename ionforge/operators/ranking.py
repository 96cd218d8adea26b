"""Global ranks and exact medians without a single-task sort."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ionforge.session import stored

#: Hex digits of a level of buckets (4,096 in a window), and rows that a bucket of the last level should hold at most.
LEVEL_DIGITS, BUCKET_ROWS = 3, 100_000
#: Parts that a histogram bin is cut into.
BINS = 1024


def bucket_levels(rows):
    """Levels of 4,096 buckets each, so that the last level's buckets hold few enough rows."""
    levels = 1
    while rows > BUCKET_ROWS * 16 ** (LEVEL_DIGITS * levels):
        levels += 1
    return levels


def hash_rank(df, hash_col, out="rank", within=(), levels=None):
    """0-based rank by a uniformly distributed hex hash, per ``within`` class.

    Rows fall into hash-prefix buckets, whose number grows with the rows. A
    bucket's offset is the sum of one offset per level: the rows of the buckets
    before it under the same shorter prefix, so no ordered window has more than
    4,096 buckets. Only inside a bucket are rows sorted.
    """
    within = list(within)
    if levels is None:
        levels = bucket_levels(df.count())
    one = [] if within else ["__all"]
    df = df.withColumn("__bucket", F.substring(hash_col, 1, LEVEL_DIGITS * levels))
    df = df if within else df.withColumn("__all", F.pmod(F.length("__bucket"), F.lit(1)))
    classes = within or one
    offsets = stored(df.groupBy(*classes, "__bucket").agg(F.count(F.lit(1)).alias("__n")), "buckets")
    total = F.lit(0).cast("bigint")
    for level in range(levels):
        upper, lower = F.substring("__bucket", 1, LEVEL_DIGITS * level), F.substring("__bucket", 1, LEVEL_DIGITS * (level + 1))
        sums = offsets.groupBy(*classes, upper.alias("__up"), lower.alias("__low")).agg(F.sum("__n").alias("__m"))
        before = F.sum("__m").over(Window.partitionBy(*classes, "__up").orderBy("__low").rowsBetween(Window.unboundedPreceding, -1))
        sums = sums.select(*classes, "__low", F.coalesce(before, F.lit(0)).alias(f"__before{level}"))
        offsets = offsets.withColumn("__low", lower).join(sums, [*classes, "__low"]).drop("__low")
        total = total + F.col(f"__before{level}")
    offsets = offsets.select(*classes, "__bucket", total.alias("__before"))
    inside = Window.partitionBy(*classes, "__bucket").orderBy(hash_col)
    ranked = df.join(offsets, [*classes, "__bucket"])
    return (ranked.withColumn(out, (F.col("__before") + F.row_number().over(inside) - 1).cast("bigint"))
            .drop("__bucket", "__before", *one))


def _to_scopes(counts, fold, scopes):
    """Counts of a fold serve every scope that it belongs to; the rows themselves are never copied."""
    return counts.withColumn(scopes[0], F.explode(scopes[1])).drop(*fold) if fold else counts


def exact_median(df, groups, value, out="median", fold=None, scopes=None):
    """Exact interpolating median of each (small-cardinality) group.

    With ``fold`` and ``scopes`` (a name, and the column of scopes that a row's
    fold belongs to) there is a median per group and scope: rows are counted by
    fold, and only the counts are added up for each scope.

    A histogram is refined bin by bin: the one or two bins that hold the middle
    ranks are cut into ``BINS`` again between their own smallest and largest
    values, until such a bin holds a single value. A pass keeps at most two bins
    per median, so an outlier costs a pass, and no bin's rows meet in one task.
    """
    groups, fold = list(groups), [fold] if fold else []
    rows = df.where(F.col(value).isNotNull()).select(*groups, *fold, F.col(value).cast("double").alias("v"))
    if not groups:
        rows, groups = rows.withColumn("all_rows", F.pmod(F.hash("v"), F.lit(1))), ["all_rows"]
    targets = [*groups, scopes[0]] if fold else groups
    counts = _to_scopes(rows.groupBy(*groups, *fold).agg(F.count(F.lit(1)).alias("c")), fold, scopes).groupBy(*targets).agg(F.sum("c").alias("n"))
    sides = F.array(F.struct(F.lit("low").alias("side"), F.floor((F.col("n") - 1) / 2).alias("rank")), F.struct(F.lit("high").alias("side"), F.floor(F.col("n") / 2).alias("rank")))
    open_ = stored(counts.select(*targets, F.inline(sides), F.lit("").alias("cell")), "ranks")
    cells = rows.groupBy(*groups).agg(F.min("v").alias("a"), F.max("v").alias("b")).select(*groups, F.lit("").alias("cell"), "a", "b")
    settled = None
    while True:
        # at most two bins per median
        ranges = cells.groupBy(*groups).agg(F.collect_list(F.struct("cell", "a", "b")).alias("cells"))
        inside = rows.join(ranges, groups).withColumn("c", F.get(F.filter("cells", lambda c: (c["a"] <= F.col("v")) & (F.col("v") <= c["b"])), F.lit(0))).where(F.col("c").isNotNull())
        share = (F.col("v") / 2 - F.col("c.a") / 2) / (F.col("c.b") / 2 - F.col("c.a") / 2)
        at = F.when(F.col("c.b") > F.col("c.a"), F.least(F.floor(share * BINS), F.lit(BINS - 1))).otherwise(0).cast("int")
        counted = inside.groupBy(*groups, *fold, F.col("c.cell").alias("cell"), at.alias("at")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))
        counted = stored(counted, "bins")
        hist = _to_scopes(counted, fold, scopes).groupBy(*targets, "cell", "at").agg(F.sum("c").alias("c"), F.min("a").alias("a"), F.max("b").alias("b"))
        run = Window.partitionBy(*targets, "cell").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # BINS rows
        hist = hist.withColumn("before", F.coalesce(F.sum("c").over(run), F.lit(0)))
        held = (F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("c"))
        picked = stored(open_.join(hist, [*targets, "cell"]).where(held).select(
            *targets, "side", (F.col("rank") - F.col("before")).alias("rank"), "cell", "at", F.when(F.col("a") == F.col("b"), F.col("a")).alias("value")), "picked")
        done = picked.where(F.col("value").isNotNull()).select(*targets, "side", "value")
        settled = done if settled is None else settled.unionByName(done)
        left = picked.where(F.col("value").isNull())
        if left.isEmpty():
            break
        path = F.concat_ws(".", "cell", "at")
        bounds = counted.groupBy(*groups, "cell", "at").agg(F.min("a").alias("a"), F.max("b").alias("b"))
        wanted = left.select(*groups, "cell", "at").distinct()
        cells = stored(bounds.join(wanted, [*groups, "cell", "at"]).select(*groups, path.alias("cell"), "a", "b"), "cells")
        open_ = left.select(*targets, "side", "rank", path.alias("cell"))
    pick = lambda side: F.max(F.when(F.col("side") == side, F.col("value")))
    result = settled.groupBy(*targets).agg(((pick("low") + pick("high")) / 2).alias(out))
    return result.drop("all_rows")
