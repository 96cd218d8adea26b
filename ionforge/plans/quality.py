"""Registered queries: keys, deduplication, quality rules and composition algebra."""

from pyspark.sql import functions as F

from ionforge.functions import composition as comp
from ionforge.functions.keys import fingerprint, row_uid, set_digest
from ionforge.operators import dedup, formulas, intervals, splits, validate
from ionforge.plans import flows
from ionforge.plans.fixtures import (ALL_FACTS, GROUPED, HOST_TEXT, LABEL_FACT, REVIEW_FACTS, RULE_FACTS, SPLIT, SYMMETRY_FACTS, WITH, balanced,
                                     clean, composition_text, fact_any, fact_text, raw, table)
from ionforge.rules import flag_text
from ionforge.sources.tables import review_queue

# Pair rows of the nested documents, from the integers, with the part table as metadata.
PAIRS = """pairs AS (SELECT rx.*, i, CASE WHEN k % 50 = 2 THEN NULL ELSE ion END AS wion, (k + i) % 61 = 0 AS no_id, 2 * c + i AS pc, 2 * c + i + 1 AS pd,
  CASE WHEN (k + i) % 29 = 0 THEN NULL ELSE CAST(mv AS DOUBLE) / 1000 + i END AS volt,
  CAST(i AS DOUBLE) / 10 AS lo, CASE WHEN (k + i) % 19 = 0 THEN 0 ELSE CAST(i + 1 AS DOUBLE) / 10 END AS hi
  FROM rx, unnest(range(k % 4)) t(i) WHERE (k + i) % 21 <> 0),
meta AS (SELECT pairs.*, mc.p_partkey IS NOT NULL AS fc, md.p_partkey IS NOT NULL AND NOT no_id AS fd,
  mc.p_partkey IS NOT NULL AND pc % 33 <> 0 AS sysc, md.p_partkey IS NOT NULL AND NOT no_id AND pd % 33 <> 0 AS sysd,
  mc.p_partkey IS NOT NULL AND pc % 33 <> 0 AND pc % 35 <> 0 AS sgc, md.p_partkey IS NOT NULL AND NOT no_id AND pd % 33 <> 0 AND pd % 35 <> 0 AS sgd
  FROM pairs LEFT JOIN part mc ON mc.p_partkey = pc LEFT JOIN part md ON md.p_partkey = pd)"""
_ISSUES = (("missing_or_unsupported_working_ion", "wion IS NULL"), ("missing_formula_charge", "(k + i) % 17 = 0"),
           ("non_increasing_working_ion_fraction", "hi <= lo"), ("missing_or_nonfinite_voltage", "volt IS NULL"))
_WARN = (("missing_battery_id_use_record_key_for_provenance", "k % 13 = 0"),
         ("missing_material_metadata_charge", "NOT fc"), ("missing_crystal_system_charge", "NOT sysc"),
         ("missing_spacegroup_number_charge", "NOT sgc"), ("deprecated_material_charge", "fc AND pc % 50 = 0"),
         ("missing_id_discharge", "no_id"), ("missing_material_metadata_discharge", "NOT no_id AND NOT fd"),
         ("missing_crystal_system_discharge", "NOT sysd"), ("missing_spacegroup_number_discharge", "NOT sgd"),
         ("deprecated_material_discharge", "fd AND pd % 50 = 0"), ("source:w1;source:w2", "k % 7 = 0"))
_COMPLETE = f"NOT {fact_any(_ISSUES)} AND sysc AND sysd AND sgc AND sgd AND NOT no_id"
INSPECTED = (f"{WITH}, {PAIRS}, insp AS (SELECT *, {fact_text(_ISSUES)} AS issues, {fact_text(_WARN)} AS warnings, "
             f"NOT {fact_any(_ISSUES)} AS passed, {_COMPLETE} AS complete FROM meta)")
IDENTITY = f"""{INSPECTED}, ident AS (SELECT *, CASE WHEN no_id THEN 1 ELSE count(*) OVER w END AS copies,
  CASE WHEN no_id THEN FALSE ELSE coalesce(max(volt) OVER w - min(volt) OVER w > 1e-6, FALSE) END AS clash
  FROM insp WINDOW w AS (PARTITION BY coalesce(wion, ''), pc, pd, no_id)),
flagged AS (SELECT k, i, wion, volt, warnings, copies > 1 AS again, copies > 1 AND clash AS clash, passed AND NOT (copies > 1 AND clash) AS passed,
  complete AND NOT (copies > 1 AND clash) AS complete,
  concat_ws(';', nullif(issues, ''), CASE WHEN copies > 1 AND clash THEN 'conflicting_interval_labels' END) AS issues,
  concat_ws(';', nullif(warnings, ''), CASE WHEN copies > 1 THEN 'repeated_interval_identity_review_required' END) AS all_warnings FROM ident)"""


def record_fingerprint(spark, sf):
    orders = table(spark, sf, "orders")
    cols = ["o_orderkey", "o_orderstatus", "o_orderpriority", "maybe"]
    rows = orders.withColumn("maybe", F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderstatus")))
    return rows.select("o_orderkey", fingerprint(rows, cols).alias("fp"))


def row_identity(spark, sf):
    rows = raw(spark, sf)
    return rows.select("source_row", row_uid(F.col("record_key"), F.col("interval_index")).alias("row_uid"))


def _event_content(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select("event_id", "user_id", "event_type", F.floor("value").cast("bigint").alias("v"),
                     F.sha2(F.concat_ws("|", "user_id", "event_type", F.floor("value").cast("bigint")), 256).alias("content"))


def collapse_exact_documents(spark, sf):
    rows = _event_content(spark, sf)
    return intervals.collapse_exact_documents(rows, "content", "event_id").select("event_id", "user_id", "event_type", "v", "copies")


def flag_exact_duplicate_rows(spark, sf):
    rows = _event_content(spark, sf)
    return dedup.flag_exact_duplicate_rows(rows, "content", "event_id").select("event_id", "exact_duplicate")


def _line_content(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", row_uid(F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("row_uid"),
                     F.sha2(F.concat_ws("|", "l_partkey", "l_suppkey"), 256).alias("content"))


def flag_identity_conflict(spark, sf):
    out = dedup.flag_identity_conflict(_line_content(spark, sf), "row_uid", "content", ["l_partkey", "l_suppkey"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "identity_conflict")


def _metadata(spark, sf):
    li = table(spark, sf, "lineitem")
    records = li.select(F.concat(F.lit("mp-"), F.col("l_orderkey")).alias("material_id"), F.col("l_linestatus").alias("status"))
    wanted = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.concat(F.lit("mp-"), F.col("o_orderkey")).alias("material_id"))
    return records, wanted


def resolve_metadata(spark, sf):
    accepted, issues = dedup.resolve_metadata(*_metadata(spark, sf))
    return (accepted.select(F.lit("accepted").alias("kind"), "material_id", "status")
            .unionByName(issues.groupBy("kind", "material_id").agg(F.lit(None).cast("string").alias("status"))))


def missing_ids(spark, sf):
    records, wanted = _metadata(spark, sf)
    return dedup.missing_ids(wanted, records)


def ordered_digest(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.groupBy("o_orderstatus").agg(set_digest(F.concat(F.lit("u"), "o_orderkey")).alias("digest"))


def _with_doc_key(spark, sf, rows):
    """Map record keys back to order keys (the fingerprint differs per document)."""
    docs = intervals.with_record_key(flows.documents(spark, sf), None).select("record_key", F.col("pos").alias("k"))
    return rows.join(docs, "record_key")


def attach_endpoint_metadata(spark, sf):
    rows = _with_doc_key(spark, sf, flows.inspected(spark, sf))
    return rows.select("k", F.col("interval_index").cast("bigint").alias("i"),
                       F.col("crystal_system_charge").isNotNull().alias("sysc"), F.col("crystal_system_discharge").isNotNull().alias("sysd"),
                       F.col("spacegroup_number_charge").alias("sg_c"), F.col("spacegroup_number_discharge").alias("sg_d"))


def inspection_rules(spark, sf):
    rows = _with_doc_key(spark, sf, flows.inspected(spark, sf))
    return rows.select("k", F.col("interval_index").cast("bigint").alias("i"), F.col("working_ion").alias("wion"),
                       flag_text("issues").alias("issues"), flag_text("warnings").alias("warnings"),
                       F.col("basic_checks_passed").alias("passed"), F.col("complete_basic_inputs").alias("complete"))


def repeated_interval_identity(spark, sf):
    rows = _with_doc_key(spark, sf, flows.repeated_checked(spark, sf))
    return rows.select("k", F.col("interval_index").cast("bigint").alias("i"), flag_text("issues").alias("issues"),
                       flag_text("warnings").alias("warnings"), F.col("basic_checks_passed").alias("passed"),
                       F.col("complete_basic_inputs").alias("complete"))


def validation_rules(spark, sf):
    rows = validate.validation_rules(raw(spark, sf))
    return rows.select("source_row", flag_text("problems").alias("problems"), flag_text("review_flags").alias("review_flags"),
                       "composition_checks_passed", "symmetry_checks_passed", "priority_voltage_review", "canonical_host",
                       F.round("delta_ion_per_reduced_host", 6).alias("delta"))


def endpoint_conflicts(spark, sf):
    rows = clean(spark, sf).withColumns({
        "id_discharge": F.concat(F.lit("mp-e"), F.substring("id_charge", 5, 20), "working_ion", F.regexp_extract("formula_discharge", "^[A-Z][a-z]?([0-9])", 1)),
        "odd": F.substring("id_charge", 5, 20).cast("bigint") % 2 == 1})
    rows = rows.withColumns({f: F.when(F.col("odd"), F.col(f)).otherwise(F.col(f.replace("discharge", "charge")))
                             for f in ("spacegroup_number_discharge", "crystal_system_discharge")})
    return validate.endpoint_conflicts(rows, ["k"]).select("k", "endpoint_conflict")


def repeated_reaction_review(spark, sf):
    ev = table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("working_ion"), F.when(F.col("user_id") % 10 == 0, "").otherwise(F.col("user_id").cast("string")).alias("id_charge"),
        F.floor("value").cast("bigint").cast("string").alias("id_discharge"), F.when(F.col("event_id") % 97 != 0, F.col("value")).alias("label"),
        F.sha2(F.concat_ws("|", "event_type", "user_id", F.floor(F.col("value") * 100).cast("bigint"), F.col("event_id") % 97 == 0), 256).alias("content"))
    ev = dedup.flag_exact_duplicate_rows(ev, "content", "event_id")
    return validate.repeated_reaction_review(ev, "label", "content", ["event_id"]).select("event_id", "exact_duplicate", "reaction_flag")


def eligibility_split(spark, sf):
    return flows.validated(spark, sf).select("source_row", flag_text("step4_issues").alias("issues"), "eligible_for_baseline")


def flag_counts(spark, sf):
    return intervals.flag_counts(flows.validated(spark, sf), "step4_issues")


def label_profile(spark, sf):
    rows = flows.repeated_checked(spark, sf).withColumn("ion", F.coalesce("working_ion", F.lit("UNKNOWN")))
    out = intervals.label_profile(rows, ["ion"])
    return out.select("ion", "n_rows", "passed", "complete", "missing", "negative", "zero",
                      *[F.round(c, 6).alias(c) for c in ("min_label", "max_label", "mean_label", "median_label")])


def dataset_report(spark, sf):
    return intervals.dataset_report(flows.split(spark, sf))


def run_report(spark, sf):
    """Documents, intervals, codes, partitions, groups and leak checks of the whole run in one table."""
    split = flows.split(spark, sf)
    audits = splits.cv_leakage_audit(split, "mixed_cv_fold", "mixed_ions").unionByName(splits.cv_leakage_audit(split, "li_cv_fold", "li_only"))
    documents = intervals.with_record_key(flows.documents(spark, sf))
    return intervals.run_report(documents, flows.repeated_checked(spark, sf), split, audits)


def priority_review_list(spark, sf):
    return validate.priority_review_list(flows.validated(spark, sf)).select("source_row", "working_ion", "label")


def review_queue_query(spark, sf):
    rows = flows.inspected(spark, sf)
    flagged = (F.size("warnings") > 0) | ~F.col("basic_checks_passed")
    return _with_doc_key(spark, sf, review_queue(rows, flagged)).select(
        "k", F.col("interval_index").cast("bigint").alias("i"), "review_decision", "evidence_reference", "reviewer_notes")


def _parsed(spark, sf):
    return formulas.parse_distinct(raw(spark, sf), ["source_row"], pc="formula_charge", pd="formula_discharge")


def parse_composition(spark, sf):
    return _parsed(spark, sf).select("source_row", comp.host_key("pc.comp").alias("charge"), comp.host_key("pd.comp").alias("discharge"),
                                     F.col("pd.error").isNotNull().alias("bad"))


def reduce_composition(spark, sf):
    rows = comp.reduce_composition(_parsed(spark, sf), r="pd.comp")
    return rows.select("source_row", comp.host_key("r").alias("reduced"), comp.composition_gcd("pd.comp").alias("divisor"))


def _hosts(spark, sf):
    rows = comp.parse_formulas(clean(spark, sf), pd="formula_discharge")
    return comp.with_host(rows, "working_ion", h="pd.comp")


def host_and_loading(spark, sf):
    return _hosts(spark, sf).select("k", F.col("h.divisor").alias("divisor"), F.col("h.ion_count").alias("ion_count"),
                                    F.round("h.loading", 9).alias("loading"), F.round("h.fraction", 9).alias("fraction"))


def host_key(spark, sf):
    return _hosts(spark, sf).select("k", comp.host_key("h.host").alias("host"))


def reaction_consistency(spark, sf):
    rows = validate.reaction_consistency(validate.with_reaction_algebra(raw(spark, sf)))
    return rows.select("source_row", "host_changed", "framework_mismatch", "non_increasing_loading", "canonical_host",
                       "fraction_mismatch_charge", "fraction_mismatch_discharge")


_REDUCED_D = composition_text("m // gcd(gcd(a, b), m)", "a // gcd(gcd(a, b), m)", "4 * b // gcd(gcd(a, b), m)", "b // gcd(gcd(a, b), m)")
_OK = "f % 23 <> 0"
_F = dict(RULE_FACTS)
_HOST = f"CASE WHEN {_OK} AND f % 47 <> 0 AND f % 17 <> 0 THEN {HOST_TEXT} ELSE '' END"
_CHARGE = f"CASE WHEN f % 71 = 0 THEN {composition_text('m + 1')} ELSE concat('Fe:', a, '|O:', 4 * b, '|P:', b) END"
_DUP = "(SELECT event_id, user_id, event_type, CAST(floor(value) AS BIGINT) AS v FROM events)"

QUERIES = {
    "record_fingerprint": (record_fingerprint, """SELECT o_orderkey, sha256(concat(
        'maybe=', CASE WHEN o_custkey % 3 <> 0 THEN concat('s', length(o_orderstatus), ':', o_orderstatus) ELSE 'n' END,
        ';o_orderkey=i', length(CAST(o_orderkey AS VARCHAR)), ':', o_orderkey, ';o_orderpriority=s', length(o_orderpriority), ':', o_orderpriority,
        ';o_orderstatus=s', length(o_orderstatus), ':', o_orderstatus, ';')) AS fp FROM orders"""),
    "row_identity": (row_identity, f"""{WITH} SELECT source_row, sha256(concat('["', record_key, '","', interval_index, '"]')) AS row_uid FROM raw"""),
    "collapse_exact_documents": (collapse_exact_documents, f"""SELECT min(event_id) AS event_id, user_id, event_type, v, count(*) AS copies
        FROM {_DUP} GROUP BY user_id, event_type, v"""),
    "flag_exact_duplicate_rows": (flag_exact_duplicate_rows, f"""SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, v ORDER BY event_id) > 1 AS exact_duplicate FROM {_DUP}"""),
    "flag_identity_conflict": (flag_identity_conflict, """SELECT l.l_orderkey, l.l_linenumber, l_partkey, l_suppkey, bad AS identity_conflict FROM lineitem l JOIN
        (SELECT l_orderkey, l_linenumber, count(DISTINCT (l_partkey, l_suppkey)) > 1 AS bad FROM lineitem GROUP BY 1, 2) g
        ON g.l_orderkey = l.l_orderkey AND g.l_linenumber = l.l_linenumber"""),
    "resolve_metadata": (resolve_metadata, """WITH w AS (SELECT o_orderkey AS o FROM orders WHERE o_orderstatus <> 'P'),
        g AS (SELECT l_orderkey AS o, count(DISTINCT l_linestatus) AS n, min(l_linestatus) AS s FROM lineitem GROUP BY 1)
        SELECT CASE WHEN w.o IS NULL THEN 'rejected_metadata_id' WHEN n = 1 THEN 'accepted' WHEN n > 1 THEN 'conflicting_metadata' ELSE 'unresolved_metadata' END AS kind,
        concat('mp-', coalesce(w.o, g.o)) AS material_id, CASE WHEN w.o IS NOT NULL AND n = 1 THEN s END AS status FROM w FULL JOIN g ON w.o = g.o
        UNION ALL SELECT 'unresolved_metadata', concat('mp-', w.o), NULL FROM w JOIN g ON w.o = g.o WHERE n > 1"""),
    "missing_ids": (missing_ids, """SELECT concat('mp-', o_orderkey) AS material_id FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"""),
    "ordered_digest": (ordered_digest, """SELECT o_orderstatus, concat(count(*), ':', sum(CAST(('0x' || substr(sha256(concat('u', o_orderkey)), 1, 15)) AS BIGINT))) AS digest FROM orders GROUP BY 1"""),
    "attach_endpoint_metadata": (attach_endpoint_metadata, f"""{WITH}, {PAIRS} SELECT k, i, sysc, sysd,
        CASE WHEN sgc THEN CAST(1 + (pc * 7) % 230 AS INT) END AS sg_c, CASE WHEN sgd THEN CAST(1 + (pd * 7) % 230 AS INT) END AS sg_d FROM meta"""),
    "inspection_rules": (inspection_rules, f"{INSPECTED} SELECT k, i, wion, issues, warnings, passed, complete FROM insp"),
    "review_queue": (review_queue_query, f"{INSPECTED} SELECT k, i, 'pending' AS review_decision, '' AS evidence_reference, '' AS reviewer_notes FROM insp WHERE NOT passed OR warnings <> ''"),
    "repeated_interval_identity": (repeated_interval_identity, f"{IDENTITY} SELECT k, i, issues, all_warnings AS warnings, passed, complete FROM flagged"),
    "validation_rules": (validation_rules, f"""{WITH} SELECT k AS source_row, {fact_text(ALL_FACTS)} AS problems, {fact_text(REVIEW_FACTS)} AS review_flags,
        NOT {fact_any(RULE_FACTS)} AS composition_checks_passed, NOT {fact_any(SYMMETRY_FACTS)} AS symmetry_checks_passed,
        f % 29 <> 0 AND mv > 10000 AS priority_voltage_review, {_HOST} AS canonical_host,
        CASE WHEN {_OK} THEN round(CASE WHEN f % 47 = 0 THEN 0 WHEN f % 71 = 0 THEN CAST(-1 AS DOUBLE) / gcd(a, b) ELSE CAST(m AS DOUBLE) / gcd(a, b) END, 6) END AS delta FROM rx"""),
    "endpoint_conflicts": (endpoint_conflicts, f"""{WITH} SELECT k, q % 2 = 1 AND min(sg_d) OVER (PARTITION BY q, ion, m) <> max(sg_d) OVER (PARTITION BY q, ion, m) AS endpoint_conflict FROM rx"""),
    "repeated_reaction_review": (repeated_reaction_review, """WITH e AS (SELECT event_id, event_type, user_id, floor(value) AS fv, CASE WHEN event_id % 97 <> 0 THEN value END AS label,
        row_number() OVER (PARTITION BY event_type, user_id, floor(value * 100), event_id % 97 = 0 ORDER BY event_id) > 1 AS exact_duplicate FROM events),
        g AS (SELECT event_type, user_id, fv, count(*) AS n, bool_or(label IS NULL) OR max(label) - min(label) > 1e-8 AS clash FROM e WHERE NOT exact_duplicate AND user_id % 10 <> 0 GROUP BY 1, 2, 3)
        SELECT event_id, exact_duplicate, CASE WHEN exact_duplicate OR n IS NULL OR n < 2 THEN NULL WHEN clash THEN 'conflicting_reaction_labels'
        ELSE 'repeated_reaction_requires_provenance_review' END AS reaction_flag FROM e LEFT JOIN g USING (event_type, user_id, fv)"""),
    "eligibility_split": (eligibility_split, f"""{WITH}, t AS (SELECT k AS source_row, {fact_text(ALL_FACTS)} AS p FROM rx)
        SELECT source_row, array_to_string(list_sort(string_split(p, ';')), ';') AS issues, p = '' AS eligible_for_baseline FROM t"""),
    "flag_counts": (flag_counts, f"""{WITH}, t AS (SELECT unnest(string_split({fact_text(ALL_FACTS)}, ';')) AS flag FROM rx) SELECT flag, count(*) AS n FROM t WHERE flag <> '' GROUP BY 1"""),
    "label_profile": (label_profile, f"""{IDENTITY} SELECT coalesce(wion, 'UNKNOWN') AS ion, count(*) AS n_rows, CAST(count_if(passed) AS BIGINT) AS passed, CAST(count_if(complete) AS BIGINT) AS complete,
        CAST(count_if(volt IS NULL) AS BIGINT) AS missing, CAST(count_if(volt < 0) AS BIGINT) AS negative, CAST(count_if(volt = 0) AS BIGINT) AS zero, round(min(volt), 6) AS min_label, round(max(volt), 6) AS max_label,
        round(avg(volt), 6) AS mean_label, round(median(volt), 6) AS median_label FROM flagged GROUP BY 1"""),
    "run_report": (run_report, f"""{IDENTITY}, {SPLIT}, token AS (SELECT 'issues' AS section, unnest(string_split(issues, ';')) AS item FROM flagged WHERE issues <> ''
          UNION ALL SELECT 'warnings', unnest(string_split(all_warnings, ';')) FROM flagged WHERE all_warnings <> '')
        SELECT 'documents' AS section, 'raw' AS item, count(*)::BIGINT AS n FROM rx UNION ALL SELECT 'documents', 'unique', count(*) FROM rx UNION ALL SELECT 'documents', 'without_pairs', count_if(k % 4 = 0) FROM rx
        UNION ALL SELECT 'documents', 'missing_pairs', count(*) FROM rx, unnest(range(k % 4)) t(i) WHERE (k + i) % 21 = 0
        UNION ALL SELECT 'intervals', 'rows', count(*) FROM flagged UNION ALL SELECT 'intervals', 'passed', count_if(passed) FROM flagged UNION ALL SELECT 'intervals', 'complete', count_if(complete) FROM flagged
        UNION ALL SELECT section, item, count(*) FROM token GROUP BY 1, 2
        UNION ALL SELECT 'partition_rows', partition, count(*) FROM split GROUP BY 2 UNION ALL SELECT 'partition_groups', partition, count(DISTINCT group_id) FROM split GROUP BY 2
        UNION ALL SELECT 'groups', 'number', count(DISTINCT group_id) FROM split UNION ALL SELECT 'groups', 'largest', max(n) FROM (SELECT count(*) AS n FROM split GROUP BY group_id)
        UNION ALL SELECT 'checks', 'fold_pairs', 20 UNION ALL SELECT 'checks', 'shared_tokens', 0 UNION ALL SELECT 'checks', 'empty_sides', 0"""),
    "dataset_report": (dataset_report, f"""{WITH}, {SPLIT} SELECT partition, working_ion, count(*) AS n_rows, count(DISTINCT group_id) AS n_groups,
        CAST(grouping(partition, working_ion) AS BIGINT) AS grain FROM split GROUP BY GROUPING SETS ((partition), (partition, working_ion), ())"""),
    "priority_review_list": (priority_review_list, f"""{WITH} SELECT k AS source_row, CASE WHEN f % 47 = 0 THEN 'Rb' ELSE ion END AS working_ion, CAST(mv AS DOUBLE) / 1000 AS label
        FROM rx WHERE f % 29 <> 0 AND (mv > 10000 OR mv < -3000)"""),
    "parse_composition": (parse_composition, f"""{WITH} SELECT k AS source_row, {_CHARGE} AS charge, CASE WHEN {_OK} THEN {composition_text('m')} END AS discharge, NOT ({_OK}) AS bad FROM rx"""),
    "reduce_composition": (reduce_composition, f"""{WITH} SELECT k AS source_row, CASE WHEN {_OK} THEN {_REDUCED_D} END AS reduced, CASE WHEN {_OK} THEN gcd(gcd(a, b), m) END AS divisor FROM rx"""),
    "host_and_loading": (host_and_loading, f"""{WITH} SELECT k, gcd(a, b) AS divisor, m AS ion_count, round(CAST(m AS DOUBLE) / gcd(a, b), 9) AS loading,
        round(CAST(m AS DOUBLE) / (m + a + 5 * b), 9) AS fraction FROM rx"""),
    "host_key": (host_key, f"{WITH} SELECT k, {HOST_TEXT} AS host FROM rx"),
    "reaction_consistency": (reaction_consistency, f"""{WITH} SELECT k AS source_row, {_F['host_composition_changed']} AS host_changed,
        {_F['framework_composition_mismatch']} AS framework_mismatch, {_F['non_increasing_ion_loading']} AS non_increasing_loading, {_HOST} AS canonical_host,
        {_F['formula_fraction_mismatch_charge']} AS fraction_mismatch_charge, {_F['formula_fraction_mismatch_discharge']} AS fraction_mismatch_discharge FROM rx"""),
}
