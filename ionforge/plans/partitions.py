"""Registered queries: components, holdouts, folds, overlap audits."""

from pyspark.sql import functions as F

from ionforge.constants import IONS, SplitSettings
from ionforge.operators import components, splits
from ionforge.plans import flows
from ionforge.plans.fixtures import GROUPED, SPLIT, WITH, clean, greedy_folds, table


def connected_groups(spark, sf):
    return flows.grouped(spark, sf).select("source_row", "group_id")


def connected_groups_bipartite(spark, sf):
    """Order-part graph of every line item: one giant component plus whatever is left."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("o"), F.col("l_partkey").cast("string").alias("p"))
    rows = li.withColumn("uid", F.concat("o", F.lit("-"), "p"))
    return components.connected_groups(rows, "uid", [("order", "o"), ("part", "p")]).groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))


def group_stats(spark, sf):
    return components.group_stats(flows.grouped(spark, sf))


def _customers(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("group_id"))


def hash_holdout(spark, sf):
    return splits.hash_holdout(_customers(spark, sf))


def balanced_group_folds(spark, sf):
    return splits.balanced_group_folds(_customers(spark, sf), "mixed_cv").select("group_id", F.col("fold").cast("bigint").alias("fold"), "group_rows")


def assign_partitions(spark, sf):
    return flows.split(spark, sf).select("source_row", "group_id", "partition", F.col("mixed_cv_fold").cast("bigint").alias("mixed_cv_fold"),
                                         F.col("li_cv_fold").cast("bigint").alias("li_cv_fold"))


def shared_group_flags(spark, sf):
    rows = clean(spark, sf).select("k", F.col("record_key").alias("group_id"), F.col("working_ion").alias("ion"))
    transfer = rows.where(F.col("ion").isin("Na", "K"))
    return splits.shared_group_flags(transfer, rows.where("ion = 'Li'"), spread=["k"]).select("k", "shares_group")


def overlap_counts(spark, sf):
    rows = clean(spark, sf).withColumns({"side": F.col("working_ion") == "Li", "group_id": F.col("record_key"),
                                         "canonical_host": F.col("framework_formula")})
    return splits.overlap_counts(rows, "side")


def cv_leakage_audit(spark, sf):
    """Both fold populations of the split, and naive per-row folds that do leak."""
    split = flows.split(spark, sf)
    naive = split.withColumn("naive_fold", (F.col("source_row") % 10).cast("int"))
    return (splits.cv_leakage_audit(split, "mixed_cv_fold", "mixed_ions")
            .unionByName(splits.cv_leakage_audit(split, "li_cv_fold", "li_only"))
            .unionByName(splits.cv_leakage_audit(naive, "naive_fold", "naive")))


def holdout_overlap(spark, sf):
    rows = flows.split(spark, sf).where("partition IN ('development', 'holdout')").withColumn("side", F.col("partition") == "holdout")
    return splits.overlap_counts(rows, "side")


def partition_summary(spark, sf):
    return splits.partition_summary(flows.split(spark, sf))


def transfer_overlap_counts(spark, sf):
    return splits.transfer_overlap_counts(flows.split(spark, sf))


def fold_invariants(spark, sf):
    rows = clean(spark, sf)
    k = F.col("k")
    rows = rows.select(F.when(k % 41 == 0, "").otherwise(F.concat(F.lit("u"), (k - (k % 97 == 0).cast("bigint")))).alias("row_uid"),
                       F.col("record_key").alias("group_id"), F.when(k % 43 == 0, "Rb").otherwise(F.col("working_ion")).alias("ion"),
                       F.when(F.col("working_ion").isin("Na", "K"), "holdout").otherwise("development").alias("role"),
                       F.when(k % 53 == 0, float("nan")).otherwise(F.col("label")).alias("y"),
                       F.when(F.col("working_ion") == "Na", -1).otherwise((k % 3).cast("int") - 1).alias("fold"))
    return splits.fold_invariants(rows, IONS)


def split_guard(spark, sf):
    """Every rule of the split over feature rows with one kind of fault each."""
    k = F.col("k")
    rows = flows.modelled(spark, sf)
    fold = F.when(F.col("role") != "development", -1).when(k % 89 == 0, 7).when(k % 83 != 0, F.col("fold"))
    rows = rows.withColumn("partition", F.when(k % 67 == 0, "holdout").otherwise(F.col("role"))).withColumns({
        "row_uid": F.when(k % 41 == 0, "").otherwise(F.concat(F.lit("u"), k - (k % 97 == 0).cast("bigint"))), "group_id": F.when(k % 59 != 0, F.col("group_id")),
        "fold": fold, "eligible": k % 71 != 0, "ion": F.when(k % 73 == 0, "Na").otherwise(F.col("ion")), "y": F.when(k % 53 == 0, float("nan")).otherwise(F.col("y")),
        "val": F.when(k % 79 == 0, F.array(F.lit(float("inf")))).otherwise(F.col("val")), "role": F.when(k % 61 == 0, "archive").otherwise(F.col("role"))})
    return splits.split_guard(rows, flows.FOLDS)


_TOK = """SELECT {extra}, 'group' AS kind, group_id AS token FROM {src} UNION ALL SELECT {extra}, 'record', record_key FROM {src}
  UNION ALL SELECT {extra}, 'endpoint', id_charge FROM {src} UNION ALL SELECT {extra}, 'endpoint', id_discharge FROM {src}
  UNION ALL SELECT {extra}, 'host', canonical_host FROM {src}"""
_KINDS = ("group", "record", "endpoint", "host")
_SHARED = ", ".join(f"coalesce(max(CASE WHEN kind = '{k}' THEN shared END), 0) AS shared_{k}" for k in _KINDS)
AUDIT = f"""{WITH}, {SPLIT}, d AS (SELECT 'mixed_ions' AS population, mixed_cv_fold AS fold, * FROM split WHERE partition = 'development'
  UNION ALL SELECT 'li_only', li_cv_fold, * FROM split WHERE li_cv_fold IS NOT NULL
  UNION ALL SELECT 'naive', k % 10, * FROM split WHERE partition = 'development'),
tok AS (SELECT * FROM ({_TOK.format(extra='population, fold', src='d')}) WHERE token <> ''),
span AS (SELECT population, kind, token FROM tok GROUP BY ALL HAVING count(DISTINCT fold) > 1),
sh AS (SELECT population, fold, kind, count(DISTINCT token) AS shared FROM tok JOIN span USING (population, kind, token) GROUP BY ALL),
sizes AS (SELECT population, fold, count(*) AS n, sum(count(*)) OVER (PARTITION BY population) AS total FROM d GROUP BY 1, 2)
SELECT population, CAST(fold AS INT) AS fold, CAST(total - n AS BIGINT) AS train_rows, n AS validation_rows, {_SHARED}
FROM sizes LEFT JOIN sh USING (population, fold) GROUP BY ALL"""

QUERIES = {
    "connected_groups": (connected_groups, f"{WITH}, {GROUPED} SELECT source_row, group_id FROM grouped"),
    "connected_groups_bipartite": (connected_groups_bipartite, """WITH RECURSIVE e AS (SELECT concat('o', l_orderkey) AS u, concat('p', l_partkey) AS v FROM lineitem
        UNION SELECT concat('p', l_partkey), concat('o', l_orderkey) FROM lineitem),
        cc(node, label) USING KEY (node) AS (SELECT DISTINCT u, u FROM e UNION
          SELECT e.v, min(cc.label) FROM cc JOIN e ON e.u = cc.node JOIN recurring.cc r ON r.node = e.v WHERE cc.label < r.label GROUP BY e.v)
        SELECT group_id, sum(n)::BIGINT AS n FROM (SELECT concat('g_', min(concat(l_orderkey, '-', l_partkey))) AS group_id, count(*) AS n
          FROM lineitem JOIN cc ON cc.node = concat('o', l_orderkey) GROUP BY cc.label) GROUP BY 1"""),
    "group_stats": (group_stats, f"{WITH}, {GROUPED} SELECT count(*) AS groups, max(n) AS largest_group_rows FROM (SELECT count(*) AS n FROM grouped GROUP BY group_id)"),
    "hash_holdout": (hash_holdout, """SELECT CAST(o_custkey AS VARCHAR) AS group_id, row_number() OVER (ORDER BY sha256(concat('[42,"holdout","', o_custkey, '"]')))
        <= ceil(CAST(0.1 AS DOUBLE) * count(*) OVER ()) AS held FROM (SELECT DISTINCT o_custkey FROM orders)"""),
    "balanced_group_folds": (balanced_group_folds, f"""WITH RECURSIVE src AS (SELECT CAST(o_custkey AS VARCHAR) AS group_id FROM orders), {greedy_folds('mixed', 'src', 'mixed_cv', 10)}
        SELECT group_id, fold, n AS group_rows FROM mixed"""),
    "assign_partitions": (assign_partitions, f"{WITH}, {SPLIT} SELECT source_row, group_id, partition, mixed_cv_fold, li_cv_fold FROM split"),
    "shared_group_flags": (shared_group_flags, f"{WITH} SELECT k, c IN (SELECT c FROM rx WHERE ion = 'Li') AS shares_group FROM rx WHERE ion IN ('Na', 'K')"),
    "overlap_counts": (overlap_counts, f"""{WITH}, t AS (SELECT record_key AS group_id, record_key, id_charge, id_discharge, framework_formula AS canonical_host, working_ion = 'Li' AS side FROM clean),
        tok AS ({_TOK.format(extra='side', src='t')}), g AS (SELECT kind, token, count(DISTINCT side) AS s FROM tok WHERE token <> '' GROUP BY ALL)
        SELECT kind, CAST(count_if(s = 2) AS BIGINT) AS shared FROM g GROUP BY 1"""),
    "cv_leakage_audit": (cv_leakage_audit, AUDIT),
    "holdout_overlap": (holdout_overlap, f"""{WITH}, {SPLIT}, t AS (SELECT *, partition = 'holdout' AS side FROM split WHERE partition IN ('development', 'holdout')),
        tok AS ({_TOK.format(extra='side', src='t')}), g AS (SELECT kind, token, count(DISTINCT side) AS s FROM tok WHERE token <> '' GROUP BY ALL)
        SELECT kind, CAST(count_if(s = 2) AS BIGINT) AS shared FROM g GROUP BY 1"""),
    "partition_summary": (partition_summary, f"""{WITH}, {SPLIT} SELECT partition, working_ion, count(*) AS n_rows, CAST(sum(count(*)) OVER (PARTITION BY partition) AS BIGINT) AS partition_rows,
        max(g) AS partition_groups FROM split JOIN (SELECT partition, count(DISTINCT group_id) AS g FROM split GROUP BY 1) USING (partition) GROUP BY 1, 2"""),
    "transfer_overlap_counts": (transfer_overlap_counts, f"""{WITH}, {SPLIT} SELECT working_ion AS ion, population, CAST(count_if(s) AS BIGINT) AS shared_rows, CAST(count_if(NOT s) AS BIGINT) AS new_rows FROM
        (SELECT working_ion, 'mixed' AS population, in_mixed AS s FROM split WHERE partition LIKE 'held_out_%' UNION ALL SELECT working_ion, 'li', in_li FROM split WHERE partition LIKE 'held_out_%') GROUP BY 1, 2"""),
    "fold_invariants": (fold_invariants, f"""{WITH}, t AS (SELECT CASE WHEN k % 41 = 0 THEN '' ELSE concat('u', CASE WHEN k % 97 = 0 THEN k - 1 ELSE k END) END AS uid, c,
          CASE WHEN k % 43 = 0 THEN 'Rb' ELSE ion END AS ion, ion IN ('Na', 'K') AS held, k % 53 = 0 AS bad_y, CASE WHEN ion = 'Na' THEN -1 ELSE k % 3 - 1 END AS fold FROM rx)
        SELECT count(*) AS n_rows, CAST(count_if(NOT held AND fold < 0) AS BIGINT) AS development_without_fold, CAST(count_if(held AND fold <> -1) AS BIGINT) AS fold_outside_development,
        CAST(count_if(ion = 'Rb') AS BIGINT) AS unexpected_ion, CAST(count_if(bad_y) AS BIGINT) AS nonfinite_target, CAST(count_if(uid = '') AS BIGINT) AS missing_uid,
        (SELECT count(*) FROM (SELECT c FROM t WHERE NOT held GROUP BY c HAVING min(fold) <> max(fold))) AS groups_spanning_folds,
        (SELECT count(*) FROM (SELECT uid FROM t GROUP BY uid HAVING count(*) > 1)) AS repeated_uids FROM t"""),
    "split_guard": (split_guard, f"""{WITH}, b AS (SELECT k, c, ion AS ion0, CASE WHEN ion IN ('Na', 'K') THEN concat('held_out_', ion) WHEN c % 10 = 0 THEN 'holdout' ELSE 'development' END AS role0 FROM rx),
        t AS (SELECT k, CASE WHEN k % 59 <> 0 THEN c END AS grp, CASE WHEN k % 41 = 0 THEN '' ELSE concat('u', CASE WHEN k % 97 = 0 THEN k - 1 ELSE k END) END AS uid,
          CASE WHEN k % 67 = 0 THEN 'holdout' ELSE role0 END AS part, CASE WHEN k % 61 = 0 THEN 'archive' ELSE role0 END AS role, CASE WHEN k % 73 = 0 THEN 'Na' ELSE ion0 END AS ion,
          CASE WHEN role0 <> 'development' THEN -1 WHEN k % 89 = 0 THEN 7 WHEN k % 83 <> 0 THEN c % 5 END AS fold FROM b),
        u AS (SELECT *, role <> 'archive' AS known, role LIKE 'held_out_%' AS held FROM t)
        SELECT 'missing_uid' AS rule, count_if(uid = '')::BIGINT AS n FROM u UNION ALL SELECT 'missing_group', count_if(grp IS NULL) FROM u UNION ALL SELECT 'unknown_role', count_if(NOT known) FROM u
        UNION ALL SELECT 'role_against_partition', count_if(known AND role <> part) FROM u UNION ALL SELECT 'ineligible_row', count_if(k % 71 = 0) FROM u
        UNION ALL SELECT 'ion_against_role', count_if(known AND NOT CASE WHEN held THEN role = concat('held_out_', ion) ELSE ion NOT IN ('Na', 'K') END) FROM u
        UNION ALL SELECT 'development_without_fold', count_if(role = 'development' AND coalesce(fold, -1) NOT BETWEEN 0 AND 4) FROM u
        UNION ALL SELECT 'fold_outside_development', count_if(known AND role <> 'development' AND coalesce(fold, 0) <> -1) FROM u
        UNION ALL SELECT 'nonfinite_target', count_if(k % 53 = 0) FROM u UNION ALL SELECT 'nonfinite_features', count_if(k % 79 = 0) FROM u
        UNION ALL SELECT 'group_spans_folds', count(*) FROM (SELECT grp FROM u WHERE grp IS NOT NULL AND role = 'development' GROUP BY 1 HAVING min(fold) <> max(fold))
        UNION ALL SELECT 'group_in_development_and_holdout', count(*) FROM (SELECT grp FROM u WHERE grp IS NOT NULL GROUP BY 1 HAVING bool_or(role = 'development') AND bool_or(role = 'holdout'))
        UNION ALL SELECT 'repeated_uid', count(*) FROM (SELECT uid FROM u WHERE uid <> '' GROUP BY 1 HAVING count(*) > 1)
        UNION ALL SELECT 'empty_development', 1 - max((role = 'development')::INT) FROM u"""),
}
