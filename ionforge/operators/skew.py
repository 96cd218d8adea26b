"""Key lookups that stay balanced when one key holds a large share of the rows.

A key is *hot* when it owns more than a quarter of an average shuffle task's
rows, so by counting there are fewer than four hot keys per shuffle partition.
Their values are broadcast, and rows with a hot or null key carry a salt in the
shuffle join, so they spread over all tasks.  Every other key joins as usual.
The rule is the same at every size, and no key is left out.
"""

from functools import reduce

from pyspark.sql import functions as F

from ionforge.session import stored

HOT_PER_TASK = 4
SALTS = 4096


def _all(conditions):
    return reduce(lambda a, b: a & b, conditions)


def hot_rows(stats, n="n"):
    """Keys above the hot share of all counted rows: fewer than HOT_PER_TASK per shuffle partition.

    ``stats`` should be stored: it is read for the total and for the keys.
    """
    tasks = int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = stats.agg(F.sum(n)).first()[0] or 0
    return stats.where(F.col(n) > total / (HOT_PER_TASK * tasks))


def _balanced_left_join(df, table, hot, keys, values, spread):
    """Left join on ``keys``; ``hot`` is the bounded table of hot keys."""
    columns = [F.col(c) for c in df.columns]
    packed = F.struct(*[F.col(v) for v in values])
    salted = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    hot_side = F.broadcast(hot.select(*[F.col(k).alias(f"__h_{k}") for k in keys], packed.alias("__hot")))
    out = df.join(hot_side, _all([F.col(k) == F.col(f"__h_{k}") for k in keys]), "left")
    salted = salted | F.col("__hot").isNotNull()
    salt = F.when(salted, 1 + F.pmod(F.xxhash64(*spread), F.lit(SALTS)))
    out = out.withColumn("__salt", F.coalesce(salt, F.lit(0)).cast("bigint"))
    # The table's salt is always 0 but not a literal, so it stays a hash key of the join.
    cold = table.select(*[F.col(k).alias(f"__c_{k}") for k in keys],
                        F.pmod(F.xxhash64(*keys), F.lit(1)).cast("bigint").alias("__cs"), packed.alias("__cold"))
    on = [F.col(k) == F.col(f"__c_{k}") for k in keys] + [F.col("__salt") == F.col("__cs")]
    out = out.join(cold, _all(on), "left")
    found = F.coalesce(F.col("__hot"), F.col("__cold"))
    return out.select(*columns, *[found[v].alias(v) for v in values])


def attach(df, stats, keys, values, spread, n="n"):
    """Left-join per-key statistics (one row per key, with row count ``n``) to their rows.

    The statistics are stored first, so they are aggregated once.
    """
    kept = stats.select(*dict.fromkeys([*keys, *values, n]))
    return attach_stored(df, stored(kept, "stats"), keys, values, spread, n)


def attach_stored(df, stats, keys, values, spread, n="n"):
    """``attach`` for statistics that are stored already."""
    return _balanced_left_join(df, stats, hot_rows(stats, n), keys, values, spread)


def lookup(df, dim, keys, values, spread, counted=None):
    """Left-join a large dimension (unique keys) when the fact keys may be skewed.

    ``counted`` may name a cheaper plan of the same rows to count keys from.
    """
    freq = stored((df if counted is None else counted).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "frequency")
    hot = dim.join(F.broadcast(hot_rows(freq).select(*keys)), keys, "left_semi")
    return _balanced_left_join(df, dim, hot, keys, values, spread)
