"""Registered queries: sources, sinks, integrity and reshaping."""

from pyspark.sql import functions as F

from ionforge.constants import CRYSTAL_SYSTEMS
from ionforge.functions.values import bucket_lookup, finite_number, normalize_symbol
from ionforge.operators import features, intervals, scoring
from ionforge.plans import flows
from ionforge.plans.fixtures import SPLIT, SYSTEM, WITH, clean, raw, table
from ionforge.plans.quality import INSPECTED
from ionforge.rules import flag_text
from ionforge.session import scratch_path
from ionforge.sources import records, runs, snapshot, tables


def read_records_jsonl(spark, sf):
    path = scratch_path(spark, "jsonl")
    table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").write.json(path)
    return records.read_records(spark, path, "o_orderkey bigint, o_orderstatus string, o_totalprice double")


def _torn(spark, sf):
    path = scratch_path(spark, "torn")
    lines = table(spark, sf, "orders").select(F.to_json(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("name"))).alias("value"))
    lines.write.text(path)
    # One five-row file whose last line was cut while being written.
    tail = table(spark, sf, "region").select(F.col("r_regionkey").alias("pos"), F.to_json(F.struct(
        F.col("r_regionkey").cast("bigint").alias("k"), F.col("r_name").alias("name"))).alias("value"))
    cut = spark.createDataFrame([(99, '{"k": 99, "na'), (98, "  ")], "pos int, value string")
    tail.unionByName(cut).repartition(1).sortWithinPartitions("pos").select("value").write.mode("append").text(path)
    return records.read_jsonl_torn_tail(spark, path, "k bigint, name string")


def read_jsonl_torn_tail(spark, sf):
    good, issues = _torn(spark, sf)
    return good.unionByName(issues.select(F.col("line").alias("k"), F.col("kind").alias("name")))


def read_strict_csv(spark, sf):
    path = scratch_path(spark, "csv")
    table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("key"), F.col("p_name").alias("name"),
                                    F.concat(F.lit(' "q", '), "p_type").alias("quoted"), F.lit("").alias("blank")).write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return tables.read_strict_csv(spark, path, ["key", "name"])


def write_interval_tables(spark, sf):
    path = scratch_path(spark, "intervals")
    docs = intervals.with_record_key(flows.documents(spark, sf)).select("record_key", F.col("pos").alias("k"))
    rows = flows.inspected(spark, sf).join(docs, "record_key")
    columns = ("k", "interval_index", "working_ion", "issues", "warnings")
    tables.write_interval_tables(rows, path, columns)
    back = tables.read_strict_csv(spark, path, columns)
    return back.select(F.col("k").cast("bigint").alias("k"), F.col("interval_index").cast("bigint").alias("i"), F.col("working_ion").alias("wion"), "issues", "warnings")


def write_split_tables(spark, sf):
    path = scratch_path(spark, "split")
    rows = flows.split(spark, sf)
    columns = lambda fold: ["partition", "row_uid", "source_row", F.col(fold).cast("bigint").alias("fold")]
    own = rows.where("partition LIKE 'held_out_%' OR partition IN ('development', 'holdout') AND working_ion = 'Li'")
    for _ in range(2):  # a rerun replaces what the first has written
        tables.write_split_tables(rows.select(*columns("mixed_cv_fold")), path, "mixed_ions")
        tables.write_split_tables(own.select(*columns("li_cv_fold")), path, "li_only")
    return spark.read.parquet(path).select("model", "partition", "source_row", "fold")


def write_feature_table(spark, sf):
    path = scratch_path(spark, "features")
    rows = flows.vectors(spark, sf).withColumns({"model": F.lit("mixed_ions"), "role": F.when(F.col("ion").isin("Na", "K"), "transfer").otherwise("development")})
    tables.write_feature_table(rows, path, features.SCHEMA_HASH)
    back = tables.read_feature_table(spark, path, features.SCHEMA_HASH)
    return back.groupBy("model", "role", "fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("y"), 4).alias("sum_y"), F.sum(F.size("idx")).alias("nonzeros"))


def _manifest(spark, sf):
    """Text files of known bytes, one per bucket of parts."""
    path = scratch_path(spark, "manifest")
    part = table(spark, sf, "part").select((F.col("p_partkey") % 4).alias("bucket"), "p_partkey", F.concat_ws("|", "p_partkey", "p_size").alias("value"))
    part.repartitionByRange(4, "bucket").sortWithinPartitions("bucket", "p_partkey").drop("p_partkey").write.partitionBy("bucket").text(path)
    return path, runs.file_manifest(spark, path)


def file_manifest(spark, sf):
    path, files = _manifest(spark, sf)
    return files.select(F.regexp_extract("path", "bucket=([0-9]+)", 1).cast("bigint").alias("bucket"), "bytes", "sha256")


def verify_manifest(spark, sf):
    """One changed, one missing and one outside file among the real ones."""
    path, files = _manifest(spark, sf)
    expected = files.withColumn("sha256", F.when(F.col("path").contains("bucket=0"), F.lit("0")).otherwise(F.col("sha256")))
    expected = expected.where(~F.col("path").contains("bucket=3"))
    ghosts = spark.createDataFrame([(f"file:{path}/gone.parquet",), ("file:/elsewhere/x.parquet",)], "path string")
    expected = expected.select("path", "sha256").unionByName(ghosts.withColumn("sha256", F.lit("1")))
    return runs.verify_manifest(expected, files, path).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def publish_run(spark, sf):
    root = scratch_path(spark, "runs")
    source = table(spark, sf, "part")
    digest = runs.file_manifest(spark, f"{sf}/part.parquet").first()["sha256"]
    rid = runs.run_id("parts", digest, {"columns": 2})
    write = lambda path: source.select("p_partkey", "p_size").write.parquet(path)
    first, reused_first = runs.publish_run(spark, root, rid, write)
    second, reused_second = runs.publish_run(spark, root, rid, write)
    return spark.read.parquet(f"{second}/data").agg(F.count(F.lit(1)).alias("n")).withColumns(
        {"same_path": F.lit(first == second), "reused": F.lit(reused_second and not reused_first)})


def latest_complete_run(spark, sf):
    orders = table(spark, sf, "orders")
    rows = orders.select("o_orderpriority", F.when(F.col("o_orderstatus") == "F", "complete").otherwise("running").alias("status"),
                         F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("run_id"),
                         F.concat(F.lit("/runs/"), "o_orderkey").alias("path"))
    return runs.latest_complete_run(rows, ["o_orderpriority"])


def page_log_gaps(spark, sf):
    conv = table(spark, sf, "conversations")
    total = conv.groupBy("conv_id").agg(F.count(F.lit(1)).alias("total"))
    c, t = F.col("conv_id"), F.col("turn")
    pages = conv.join(total, "conv_id").select(
        "conv_id", F.when((c % 11 == 0) & (t == 1), t + 1).otherwise(t).alias("skip"),
        F.when((c % 13 == 0) & (t == 0), 0).otherwise(1).cast("bigint").alias("count"),
        F.when((c % 17 == 0) & (t == 0), F.col("total") + 1).otherwise(F.col("total")).alias("total"))
    return snapshot.page_log_gaps(pages, ["conv_id"]).select("conv_id", "pages", "n_rows", "bad_counts", "totals_match", "complete")


def repeated_page_check(spark, sf):
    return snapshot.repeated_page_check(table(spark, sf, "documents"), "doc_id", "text", ["lang"])


def snapshot_reconcile(spark, sf):
    ev = table(spark, sf, "events")
    u = F.col("user_id")
    declared = (ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
                .select(F.when(u % 7 == 0, -u).otherwise(u).alias("user_id"), (F.col("n") + (u % 5 == 0).cast("bigint")).alias("declared")))
    return snapshot.snapshot_reconcile(ev, declared, ["user_id"])


def version_consistency(spark, sf):
    return snapshot.version_consistency(table(spark, sf, "lineitem"), "l_linestatus", ["l_orderkey"])


def export_predictions(spark, sf):
    p = F.col("p_partkey")
    lead = F.when(p % 7 == 0, "=").when(p % 7 == 1, "+").when(p % 7 == 2, "-").when(p % 7 == 3, "@").when(p % 7 == 4, "\t").when(p % 7 == 5, "")
    rows = table(spark, sf, "part").select("p_partkey", F.concat(lead, "p_name").alias("name"), (-F.col("p_size")).alias("size"),
                                           F.array("p_brand", "p_type").alias("warnings"))
    return tables.csv_safe(rows)


def explode_intervals(spark, sf):
    docs = intervals.with_record_key(flows.documents(spark, sf))
    rows = intervals.explode_intervals(docs).join(docs.select("record_key", F.col("pos").alias("k")), "record_key")
    return rows.select("k", F.col("interval_index").cast("bigint").alias("i"), "row_type", "battery_id", "formula_charge", "formula_discharge",
                       "id_charge", "id_discharge", F.round("average_voltage", 6).alias("voltage"))


def overall_rows(spark, sf):
    docs = flows.documents(spark, sf).withColumn("record_key", F.col("pos").cast("string"))
    return intervals.overall_rows(docs).select(F.col("record_key").cast("bigint").alias("k"), "row_type", F.col("interval_index").isNull().alias("no_index"),
                                               "formula_discharge", "id_discharge", F.round("fracA_discharge", 9).alias("frac"))


def pair_counts(spark, sf):
    return intervals.pair_counts(flows.documents(spark, sf))


def requested_endpoint_ids(spark, sf):
    return intervals.requested_endpoint_ids(flows.documents(spark, sf))


def normalize_symbol_query(spark, sf):
    return flows.documents(spark, sf).select(F.col("pos").alias("k"), normalize_symbol(F.col("working_ion")).alias("symbol"))


def finite_number_query(spark, sf):
    k = F.col("source_row")
    text = (F.when(k % 9 == 0, F.concat(F.lit(" "), "average_voltage_V", F.lit(" "))).when(k % 9 == 1, F.concat(k, F.lit("e2"))).when(k % 9 == 2, "nan")
            .when(k % 9 == 3, "3d").when(k % 9 == 4, "1e400").when(k % 9 == 5, F.concat(F.lit("."), k)).when(k % 9 == 6, "-inf").otherwise(F.col("average_voltage_V")))
    return raw(spark, sf).select("source_row", finite_number(text).alias("value"))


def bucket_lookup_query(spark, sf):
    li = table(spark, sf, "lineitem")
    group = (F.col("l_partkey") % 240).cast("int")
    return li.groupBy(bucket_lookup(group, CRYSTAL_SYSTEMS).alias("system")).agg(F.count(F.lit(1)).alias("n"), F.min(group).alias("low"), F.max(group).alias("high"))


def normalize_reaction(spark, sf):
    k = F.col("k")
    rows = clean(spark, sf).withColumns({
        "spacegroup_number_charge": F.when(k % 5 == 0, F.concat("spacegroup_number_charge", F.lit(".0"))).when(k % 7 == 0, "6.5").otherwise(F.col("spacegroup_number_charge")),
        "crystal_system_discharge": F.when(k % 11 == 0, "").otherwise(F.concat(F.lit(" "), F.upper("crystal_system_discharge"), F.lit("\t"))),
        "fracA_charge": F.when(k % 13 == 0, "").when(k % 17 == 0, "1.0").otherwise(F.col("fracA_charge"))})
    out = features.normalize_reaction(rows)
    return out.select("k", "sg_charge", "system_discharge", F.col("given_fracA_charge").alias("frac"), "input_error")


def contract_check(spark, sf):
    return scoring.contract_check(flows.requests(spark, sf)).select("request_id", flag_text("violations").alias("violations"), "model_family", "training_population")


_PAIRS = """FROM rx, unnest(range(k % 4)) t(i) WHERE (k + i) % 21 <> 0"""
_LI = "('Li','Na','K')"
_REQ_ION = "CASE WHEN k % 47 = 0 THEN 'Rb' ELSE ion END"
_POP = "CASE WHEN k % 4 = 0 THEN 'li_only' WHEN k % 4 = 1 THEN 'mixed_ions' ELSE 'auto' END"
_FAM = "CASE WHEN k % 3 = 0 THEN 'auto' WHEN k % 3 = 1 THEN 'krr' ELSE 'svr' END"

QUERIES = {
    "read_records_jsonl": (read_records_jsonl, "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"),
    "read_jsonl_torn_tail": (read_jsonl_torn_tail, """SELECT o_orderkey AS k, o_orderpriority AS name FROM orders UNION ALL SELECT CAST(r_regionkey AS BIGINT), r_name FROM region
        UNION ALL SELECT 7, 'discarded_unfinished_line'"""),
    "read_strict_csv": (read_strict_csv, "SELECT CAST(p_partkey AS VARCHAR) AS key, p_name AS name, concat(' \"q\", ', p_type) AS quoted, '' AS blank FROM part"),
    "write_interval_tables": (write_interval_tables, f"{INSPECTED} SELECT k, i, coalesce(wion, '') AS wion, issues, warnings FROM insp"),
    "write_split_tables": (write_split_tables, f"""{WITH}, {SPLIT} SELECT 'mixed_ions' AS model, partition, source_row, mixed_cv_fold AS fold FROM split
        UNION ALL SELECT 'li_only', partition, source_row, li_cv_fold FROM split WHERE partition LIKE 'held_out_%' OR partition IN ('development', 'holdout') AND working_ion = 'Li'"""),
    "write_feature_table": (write_feature_table, f"""{WITH} SELECT 'mixed_ions' AS model, CASE WHEN ion IN ('Na', 'K') THEN 'transfer' ELSE 'development' END AS role,
        CAST(c % 5 AS INT) AS fold, count(*) AS n, round(sum(CAST(mv AS DOUBLE) / 1000), 4) AS sum_y, CAST(32 * count(*) AS BIGINT) AS nonzeros FROM rx GROUP BY ALL"""),
    "file_manifest": (file_manifest, """SELECT p_partkey % 4 AS bucket, sum(length(line) + 1)::BIGINT AS bytes, sha256(string_agg(concat(line, chr(10)), '' ORDER BY p_partkey)) AS sha256
        FROM (SELECT p_partkey, concat_ws('|', p_partkey, p_size) AS line FROM part) t GROUP BY 1"""),
    "verify_manifest": (verify_manifest, """SELECT status, count(*) AS n FROM (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN 'changed' WHEN 3 THEN 'unexpected' ELSE 'ok' END AS status, p_partkey % 4 AS bucket FROM part
        UNION ALL SELECT unnest(['missing', 'outside_root']), -1) t GROUP BY 1"""),
    "publish_run": (publish_run, "SELECT count(*) AS n, TRUE AS same_path, TRUE AS reused FROM part"),
    "latest_complete_run": (latest_complete_run, """WITH r AS (SELECT o_orderpriority, concat(strftime(o_orderdate, '%Y%m%d'), '_', lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS run_id,
        concat('/runs/', o_orderkey) AS path FROM orders WHERE o_orderstatus = 'F') SELECT o_orderpriority, max_by(path, run_id) AS path, max(run_id) AS run_id FROM r GROUP BY 1"""),
    "page_log_gaps": (page_log_gaps, """WITH p AS (SELECT conv_id, CASE WHEN conv_id % 11 = 0 AND turn = 1 THEN 2 ELSE turn END AS skip, CASE WHEN conv_id % 13 = 0 AND turn = 0 THEN 0 ELSE 1 END AS cnt,
          CASE WHEN conv_id % 17 = 0 AND turn = 0 THEN 1 ELSE 0 END + count(*) OVER (PARTITION BY conv_id) AS total FROM conversations),
        s AS (SELECT *, coalesce(sum(cnt) OVER (PARTITION BY conv_id ORDER BY skip, cnt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS want, sum(cnt) OVER (PARTITION BY conv_id) AS final FROM p)
        SELECT conv_id, count(*) AS pages, CAST(sum(cnt) AS BIGINT) AS n_rows, CAST(count_if(cnt <= 0) AS BIGINT) AS bad_counts, bool_and(total = final) AS totals_match,
        bool_and(skip = want AND cnt > 0 AND total = final) AS complete FROM s GROUP BY 1"""),
    "repeated_page_check": (repeated_page_check, "SELECT lang, sha256(text) AS page_hash, count(*) AS copies, min(doc_id) AS first_page FROM documents GROUP BY 1, 2 HAVING count(*) > 1"),
    "snapshot_reconcile": (snapshot_reconcile, """WITH a AS (SELECT user_id, count(*) AS actual FROM events GROUP BY 1),
        d AS (SELECT CASE WHEN user_id % 7 = 0 THEN -user_id ELSE user_id END AS user_id, actual + CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END AS declared FROM a)
        SELECT user_id, actual, declared, actual IS NOT DISTINCT FROM declared AS matches FROM a FULL JOIN d USING (user_id)"""),
    "version_consistency": (version_consistency, "SELECT l_orderkey, count(DISTINCT l_linestatus) <= 1 AS consistent FROM lineitem GROUP BY 1"),
    "export_predictions": (export_predictions, """SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, coalesce(CASE WHEN p_partkey % 7 < 5 THEN concat('''', ['=', '+', '-', '@', chr(9)][p_partkey % 7 + 1], p_name)
        WHEN p_partkey % 7 = 5 THEN p_name END, '') AS name, CAST(-p_size AS VARCHAR) AS size, concat(p_brand, ' | ', p_type) AS warnings FROM part"""),
    "explode_intervals": (explode_intervals, f"""{WITH} SELECT k, i, 'adjacent' AS row_type, CASE WHEN k % 13 <> 0 THEN concat('bat-', k) END AS battery_id,
        CASE WHEN (k + i) % 17 <> 0 THEN concat('Fe', a, '(PO4)', b) END AS formula_charge, concat(ion, m + i, 'Fe', a, '(PO4)', b) AS formula_discharge,
        concat('mp-', 2 * c + i) AS id_charge, CASE WHEN (k + i) % 61 = 0 THEN '' ELSE concat('mp-', 2 * c + i + 1) END AS id_discharge,
        CASE WHEN (k + i) % 29 <> 0 THEN round(CAST(mv AS DOUBLE) / 1000 + i, 6) END AS voltage {_PAIRS}"""),
    "overall_rows": (overall_rows, f"""{WITH} SELECT k, 'overall' AS row_type, TRUE AS no_index, concat(ion, m, 'Fe', a, '(PO4)', b) AS formula_discharge,
        CASE WHEN k % 61 = 0 THEN '' ELSE concat('mp-', 2 * c + 1) END AS id_discharge, round(CASE WHEN k % 31 = 0 THEN CAST(1.5 AS DOUBLE) ELSE CAST(m AS DOUBLE) / (m + a + 5 * b) END, 9) AS frac FROM rx"""),
    "pair_counts": (pair_counts, f"""{WITH} SELECT count(*) AS documents, CAST(count_if(k % 4 = 0) AS BIGINT) AS documents_without_pairs,
        (SELECT count(*) FROM rx, unnest(range(k % 4)) t(i) WHERE (k + i) % 21 = 0) AS malformed_pairs FROM rx"""),
    "requested_endpoint_ids": (requested_endpoint_ids, f"""{WITH} SELECT concat('mp-', 2 * c) AS material_id FROM rx UNION SELECT concat('mp-', 2 * c + 1) FROM rx WHERE k % 61 <> 0
        UNION SELECT concat('mp-', 2 * c + i) {_PAIRS} UNION SELECT concat('mp-', 2 * c + i + 1) {_PAIRS} AND (k + i) % 61 <> 0"""),
    "normalize_symbol": (normalize_symbol_query, f"{WITH} SELECT k, CASE WHEN k % 50 <> 2 THEN ion END AS symbol FROM rx"),
    "finite_number": (finite_number_query, f"""{WITH} SELECT k AS source_row, CASE WHEN k % 9 = 1 THEN CAST(k * 100 AS DOUBLE) WHEN k % 9 IN (2, 3, 4, 6) THEN NULL
        WHEN k % 9 = 5 THEN CAST(concat('0.', k) AS DOUBLE) WHEN f % 29 = 0 THEN NULL ELSE CAST(mv AS DOUBLE) / 1000 END AS value FROM rx"""),
    "bucket_lookup": (bucket_lookup_query, f"""WITH g AS (SELECT CAST(l_partkey % 240 AS INT) AS x FROM lineitem)
        SELECT {SYSTEM.format('x')} AS system, count(*) AS n, min(x) AS low, max(x) AS high FROM g GROUP BY 1"""),
    "normalize_reaction": (normalize_reaction, f"""{WITH} SELECT k, CASE WHEN k % 5 <> 0 AND k % 7 = 0 THEN NULL ELSE sg_c END AS sg_charge,
        CASE WHEN k % 11 = 0 THEN '' ELSE {SYSTEM.format('sg_d')} END AS system_discharge, CASE WHEN k % 13 = 0 THEN NULL WHEN k % 17 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS frac,
        CASE WHEN k % 5 <> 0 AND k % 7 = 0 THEN 'spacegroup_number_charge is not an integer' WHEN k % 11 = 0 THEN 'crystal_system_discharge is empty'
        WHEN k % 13 <> 0 AND k % 17 = 0 THEN 'fracA_charge is not an atom fraction' END AS input_error FROM rx"""),
    "contract_check": (contract_check, f"""{WITH}, r AS (SELECT *, {_REQ_ION} AS wi, coalesce({_POP}, 'auto') AS pop, CASE WHEN k % 19 = 0 THEN 231 ELSE sg_d END AS sgd,
          CASE WHEN k % 37 = 0 THEN 'Cubic' ELSE {SYSTEM.format('sg_d')} END AS sysd FROM rx)
        SELECT k AS request_id, concat_ws(';', CASE WHEN wi = 'Rb' THEN 'unsupported_ion' END, CASE WHEN sysd = 'Cubic' THEN 'unknown_crystal_system_discharge' END,
        CASE WHEN sgd = 231 THEN 'spacegroup_range_discharge' END, CASE WHEN sgd <> 231 AND sysd = 'Cubic' THEN 'symmetry_mismatch_discharge' END,
        CASE WHEN k % 31 = 0 THEN 'fraction_range_discharge' END, CASE WHEN pop = 'li_only' AND wi NOT IN {_LI} THEN 'li_only_route_unsupported' END) AS violations,
        {_FAM} AS model_family, pop AS training_population FROM r"""),
}
