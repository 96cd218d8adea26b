"""Registered queries: routing, scoring, references, profiles and the scoring stream."""

from pyspark.sql import functions as F

from ionforge.operators import evaluate, features, preprocess, profiles, scoring
from ionforge.operators.features import WIDTH
from ionforge.plans import flows
from ionforge.plans.fixtures import LONG, WITH, table
from ionforge.rules import flag_text
from ionforge.session import scratch_path
from ionforge.sources.tables import csv_safe
from ionforge.streaming.score import accounting_path, read_requests, score_stream


def route_model(spark, sf):
    checked = scoring.contract_check(flows.requests(spark, sf))
    return scoring.route_model(checked, flows.defaults(spark)).select("request_id", "population", "family", "route_error")


def _scored(spark, sf):
    return scoring.score_batch(flows.clean_requests(spark, sf), flows.defaults(spark), flows.linear_models(spark), states=flows.support(spark, sf))


def _stored_scores(spark, sf):
    return flows.once(spark, sf, "scored", lambda: _scored(spark, sf))


def _score_columns(rows):
    return rows.select("request_id", "population", "family", F.round("prediction", 6).alias("prediction"),
                       F.round("ion_per_host_discharge", 6).alias("loading"))


def score_batch(spark, sf):
    return _score_columns(_stored_scores(spark, sf))


def score_stream_query(spark, sf):
    """The same requests arriving as files, scored by the stream."""
    source, output = scratch_path(spark, "requests"), scratch_path(spark, "scores")
    flows.clean_requests(spark, sf).repartition(4, "request_id").write.parquet(source)
    stream = read_requests(spark, source, spark.read.parquet(source).schema, files_per_trigger=2)
    query = score_stream(stream, flows.defaults(spark), flows.linear_models(spark), output, scratch_path(spark, "progress"))
    query.awaitTermination()
    return _score_columns(spark.read.parquet(output).where("outcome = 'scored'"))


def _arriving(spark, sf):
    """Requests with contract faults, impossible routes, broken formulas, and a family that was never fitted."""
    k = F.col("request_id")
    return flows.requests(spark, sf).withColumn("model_family", F.when(k % 11 == 0, "dnn").otherwise(F.col("model_family")))


def score_accounting(spark, sf):
    """The stream over faulty requests with the fitted models: what came in is scored or rejected, once."""
    source, output = scratch_path(spark, "arriving"), scratch_path(spark, "outcomes")
    _arriving(spark, sf).repartition(4, "request_id").write.parquet(source)
    models, defaults = flows.fitted(spark, sf)
    stream = read_requests(spark, source, spark.read.parquet(source).schema, files_per_trigger=2)
    score_stream(stream, defaults, models, output, scratch_path(spark, "progress"), states=flows.support(spark, sf)).awaitTermination()
    counted = spark.read.parquet(accounting_path(output)).agg(*[F.sum(c).alias(c) for c in ("requests", "outcomes", "scored", "rejected")])
    rows = spark.read.parquet(output)
    table = rows.agg(F.countDistinct("request_id").alias("ids"), F.count_if((F.col("outcome") == "scored") & F.col("prediction").isNotNull()).alias("predicted"),
                     F.count_if((F.col("outcome") == "rejected") & F.col("reason").isNotNull()).alias("with_reason"))
    return counted.crossJoin(F.broadcast(table))  # one row each


def score_fitted(spark, sf):
    """The clean requests scored in one pass by the fitted models of the search."""
    models, defaults = flows.fitted(spark, sf)
    rows = scoring.score_batch(flows.clean_requests(spark, sf), defaults, models, states=flows.support(spark, sf))
    near = F.abs(F.col("prediction")) < 1000
    return rows.groupBy("population").agg(F.count("*").alias("n"), F.countDistinct("request_id").alias("ids"), F.count_if(near).alias("plausible"), F.sum(F.col("changed_constants")).alias("changed"))


def prediction_warnings(spark, sf):
    out = scoring.prediction_warnings(_stored_scores(spark, sf))
    return out.select("request_id", "extrapolates_working_ion", flag_text("warnings").alias("warnings"))


def changed_constants(spark, sf):
    """Out-of-support columns per request against the lithium training states."""
    rows = flows.vectors(spark, sf)
    states = flows.once(spark, sf, "li-states", lambda: preprocess.fit_states(rows.where("ion = 'Li'"), WIDTH, flows.FOLDS))
    changed = preprocess.support_diagnostics(rows.withColumn("scope", F.lit(preprocess.ALL)), states, ["k"])
    return changed.groupBy("k").agg(F.count(F.lit(1)).alias("changed"))


def _metrics(spark, sf):
    rows = flows.evaluated(spark, sf)
    held = rows.where("role <> 'development'").select("*", F.inline(F.array(*[
        F.struct(F.lit(p).alias("population"), F.lit(f).alias("family"), F.lit(shift).alias("shift"))
        for p, f, shift in (("mixed_ions", "krr", 0.0), ("mixed_ions", "svr", 0.5), ("li_only", "krr", 1.0), ("li_only", "svr", 1.5), ("mixed_ions", "median", 2.0), ("li_only", "median", 2.5))])))
    held = held.withColumn("prediction", F.col("prediction") + F.col("shift"))
    return flows.once(spark, sf, "metrics", lambda: evaluate.subgroup_metrics(held, rows.where("role = 'development'"), ["population", "family"]))


def evaluation_reference(spark, sf):
    out = scoring.evaluation_reference(_stored_scores(spark, sf), _metrics(spark, sf))
    return out.select("request_id", "evaluation_scope", F.round("reference_mae", 6).alias("reference_mae"), F.round("ion_mae", 6).alias("ion_mae"))


def model_catalog(spark, sf):
    metrics = _metrics(spark, sf)
    models = metrics.where("family <> 'median'")
    out = scoring.model_catalog(models.select("population", "family").distinct(), models, metrics.where("family = 'median'"), flows.defaults(spark))
    return out.select("population", "family", "selected_by_cv", "consistent", *[F.round(c, 6).alias(c) for c in ("holdout_mae", "na_mae", "k_mae", "baseline_mae")])


def compare_results(spark, sf):
    left = _stored_scores(spark, sf).select("request_id", "family", "prediction")
    k = F.col("request_id")
    right = left.select(F.when(k % 19 == 0, -k - 1).otherwise(k).alias("request_id"), F.when(k % 7 == 0, "other").otherwise(F.col("family")).alias("family"),
                        (F.col("prediction") + F.when(k % 5 == 0, 0.001).otherwise(1e-9)).alias("prediction"))
    out = scoring.compare_results(left, right, ["request_id"], ["family"], ["prediction"]).where(F.size("mismatches") > 0)
    return out.select("request_id", flag_text("mismatches").alias("mismatches"))


def validate_predictions(spark, sf):
    requests = flows.clean_requests(spark, sf)
    k = F.col("request_id")
    scored = _stored_scores(spark, sf).withColumns({
        "prediction": F.when(k % 11 == 0, float("nan")).otherwise(F.col("prediction")), "ion_per_host_discharge": F.when(k % 13 == 0, 0.0).otherwise(F.col("ion_per_host_discharge")),
        "family": F.when(k % 17 != 0, F.col("family")), "request_id": F.when(k % 19 == 0, -k - 1).otherwise(k)})
    return scoring.validate_predictions(requests, scored)


def export_scores(spark, sf):
    """The download table of the scored requests: numbers untouched, text made safe."""
    rows = _stored_scores(spark, sf).select("request_id", "working_ion", "formula_charge", "population", "family", (F.col("ion_per_host_discharge") * -1).cast("decimal(12,3)").alias("minus_loading"))
    return csv_safe(rows)


# Profiles: five consecutive events form one profile of states.
def _states(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select(((e - e % 5) / 5).cast("bigint").alias("profile_id"), (e % 5).alias("pos"), F.col("value").alias("loading"), F.col("event_type").alias("formula"))


def states_to_intervals(spark, sf):
    return profiles.states_to_intervals(_states(spark, sf), fields=("formula", "loading"))


def _intervals(spark, sf):
    e = F.col("event_id")
    pos, prof = e % 5, ((e - e % 5) / 5).cast("bigint")
    return table(spark, sf, "events").select(
        prof.alias("profile_id"), pos.alias("pos"), F.when(e % 31 == 0, "Na").otherwise("Li").alias("working_ion"),
        F.when(e % 29 == 0, "svr").otherwise("auto").alias("model_family"), F.lit("auto").alias("training_population"),
        F.when(e % 23 == 0, "x").otherwise("h").alias("host"), (pos + F.when(e % 37 == 0, 0.25).otherwise(0)).cast("double").alias("start"),
        (pos + 1 + F.when(e % 41 == 0, 1e-12).otherwise(0)).cast("double").alias("end"), F.col("value"),
        F.lit(1).alias("spacegroup_number_discharge"), F.when(e % 43 == 0, 2).otherwise(1).alias("spacegroup_number_charge"),
        F.lit("triclinic").alias("crystal_system_charge"), F.lit("triclinic").alias("crystal_system_discharge"))


def profile_contiguity(spark, sf):
    return profiles.profile_contiguity(_intervals(spark, sf)).select("profile_id", "pos", flag_text("violations").alias("violations"))


def profile_steps(spark, sf):
    out = profiles.profile_steps(_intervals(spark, sf))
    return out.select("profile_id", "pos", *[F.round(c, 5).alias(c) for c in ("x1", "x2", "y")])


def profile_ticks(spark, sf):
    out = profiles.profile_ticks(_intervals(spark, sf))
    return out.select("profile_id", "axis", F.col("tick").cast("bigint").alias("tick"), F.round("tick_value", 5).alias("tick_value"), F.round("pixel", 4).alias("pixel"))


_DEF = "CASE WHEN {p} = 'li_only' THEN 'krr' ELSE 'svr' END"
_ROUTED = f"""{WITH}, rq AS (SELECT *, CASE WHEN k % 2 = 0 AND ion IN ('Li', 'Na', 'K') THEN 'li_only' ELSE 'mixed_ions' END AS population,
  CASE ion WHEN 'Li' THEN 2 WHEN 'Na' THEN 3 WHEN 'Mg' THEN 3 WHEN 'Al' THEN 3 WHEN 'Y' THEN 5 ELSE 4 END AS per, CAST(m AS DOUBLE) / gcd(a, b) AS ld, CAST(4 * b AS DOUBLE) / (a + 5 * b) AS oxy FROM rx),
rf AS (SELECT *, CASE k % 3 WHEN 0 THEN {_DEF.format(p='population')} WHEN 1 THEN 'krr' ELSE 'svr' END AS family FROM rq),
lm AS (SELECT * FROM (VALUES {', '.join(str(row) for row in flows.LINEAR)}) t(population, family, b0, w1, w2, w3)),
sc AS (SELECT rf.*, b0 + w1 * per + w2 * ld + w3 * oxy AS prediction FROM rf JOIN lm USING (population, family))"""
# Out-of-support columns of every request against the rows of its population.
_CHANGED = f"""{LONG}, pm AS (SELECT 'li_only' AS population, k FROM rx WHERE ion = 'Li' UNION ALL SELECT 'mixed_ions', k FROM rx WHERE ion NOT IN ('Na', 'K')),
pn AS (SELECT population, count(*) AS n FROM pm GROUP BY 1),
ps AS (SELECT population, idx, count(*) AS nz, sum(val) / max(n) AS mean, min(val) AS lo, max(val) AS hi, max(n) AS n FROM long JOIN pm USING (k) JOIN pn USING (population) GROUP BY 1, 2),
pf AS (SELECT pn.population, i AS idx, coalesce(mean, 0) AS mean FROM range(740) t(i) CROSS JOIN pn LEFT JOIN ps ON ps.idx = i AND ps.population = pn.population
  WHERE mean IS NULL OR CASE WHEN nz < ps.n THEN greatest(hi, 0) - least(lo, 0) ELSE hi - lo END <= 1e-12),
hit AS (SELECT sc.k, pf.idx FROM sc JOIN long ON long.k = sc.k JOIN pf ON pf.idx = long.idx AND pf.population = sc.population WHERE abs(val - mean) > 1e-9
  UNION ALL SELECT sc.k, pf.idx FROM sc JOIN pf ON pf.population = sc.population AND mean <> 0 LEFT JOIN long ON long.k = sc.k AND long.idx = pf.idx WHERE long.val IS NULL)"""
_SCORES = f"{_ROUTED} SELECT k AS request_id, population, family, round(prediction, 6) AS prediction, round(ld, 6) AS loading FROM sc"
_MET = f"""{flows.EVALUATED}, grown AS (SELECT ev.*, population, family, prediction + shift AS p FROM ev, (VALUES ('mixed_ions', 'krr', 0), ('mixed_ions', 'svr', 0.5), ('li_only', 'krr', 1), ('li_only', 'svr', 1.5),
  ('mixed_ions', 'median', 2), ('li_only', 'median', 2.5)) t(population, family, shift) WHERE role <> 'development'),
met AS (SELECT population, family, role, avg(abs(p - y)) AS mae FROM grown GROUP BY 1, 2, 3), meti AS (SELECT population, family, role, ion, avg(abs(p - y)) AS mae FROM grown GROUP BY 1, 2, 3, 4)"""
_IV = """iv AS (SELECT (event_id - event_id % 5) // 5 AS profile_id, event_id % 5 AS pos, event_id AS e, value, CASE WHEN event_id % 31 = 0 THEN 'Na' ELSE 'Li' END AS ion, CASE WHEN event_id % 29 = 0 THEN 'svr' ELSE 'auto' END AS fam,
  CASE WHEN event_id % 23 = 0 THEN 'x' ELSE 'h' END AS host, event_id % 5 + CASE WHEN event_id % 37 = 0 THEN 0.25 ELSE 0 END AS s, event_id % 5 + 1 + CASE WHEN event_id % 41 = 0 THEN 1e-12 ELSE 0 END AS t FROM events)"""
_SCALE = f"""WITH {_IV}, pr AS (SELECT profile_id, min(s) AS x0, max(t) AS x1, min(value) - greatest((max(value) - min(value)) * 0.15, abs(max(value)) * 0.02, 0.1) AS y0,
  max(value) + greatest((max(value) - min(value)) * 0.15, abs(max(value)) * 0.02, 0.1) AS y1 FROM iv GROUP BY 1)"""

QUERIES = {
    "route_model": (route_model, f"""{WITH}, r AS (SELECT *, CASE WHEN k % 47 = 0 THEN 'Rb' ELSE ion END AS wi FROM rx), p AS (SELECT *, CASE WHEN k % 4 = 0 THEN 'li_only' WHEN k % 4 = 1 THEN 'mixed_ions'
        WHEN wi IN ('Li', 'Na', 'K') THEN 'li_only' ELSE 'mixed_ions' END AS population FROM r)
        SELECT k AS request_id, population, CASE k % 3 WHEN 0 THEN {_DEF.format(p='population')} WHEN 1 THEN 'krr' ELSE 'svr' END AS family,
        CASE WHEN population = 'li_only' AND wi NOT IN ('Li', 'Na', 'K') THEN 'li_only routing is unsupported for this ion' END AS route_error FROM p"""),
    "score_batch": (score_batch, _SCORES),
    "score_stream": (score_stream_query, _SCORES),
    "score_accounting": (score_accounting, f"""{WITH}, q AS (SELECT k, k % 47 = 0 OR k % 37 = 0 OR k % 19 = 0 OR k % 31 = 0 OR k % 23 = 0 OR k % 11 = 0 OR (k % 4 = 0 AND ion NOT IN ('Li', 'Na', 'K')) AS bad FROM rx)
        SELECT count(*)::BIGINT AS requests, count(*)::BIGINT AS outcomes, count_if(NOT bad)::BIGINT AS scored, count_if(bad)::BIGINT AS rejected, count(DISTINCT k)::BIGINT AS ids,
          count_if(NOT bad)::BIGINT AS predicted, count_if(bad)::BIGINT AS with_reason FROM q"""),
    "score_fitted": (score_fitted, f"""{_ROUTED}, {_CHANGED}, c AS (SELECT k, count(*) AS changed FROM hit GROUP BY 1)
        SELECT population, count(*)::BIGINT AS n, count(DISTINCT k)::BIGINT AS ids, count(*)::BIGINT AS plausible, coalesce(sum(changed), 0)::BIGINT AS changed FROM sc LEFT JOIN c USING (k) GROUP BY 1"""),
    "prediction_warnings": (prediction_warnings, f"""{_ROUTED}, {_CHANGED}, w AS (SELECT *, CASE WHEN population = 'li_only' THEN ion <> 'Li' ELSE ion IN ('Na', 'K') END AS ex FROM sc)
        SELECT k AS request_id, ex AS extrapolates_working_ion, concat_ws(';', 'computed_reference_only', 'no_calibrated_uncertainty', CASE WHEN ex THEN 'working_ion_absent_from_training' END,
        CASE WHEN k IN (SELECT k FROM hit) THEN 'changed_training_constant_features' END, CASE WHEN prediction < 0 THEN 'negative_prediction' END, CASE WHEN prediction < -3 OR prediction > 10 THEN 'outside_review_bounds' END) AS warnings FROM w"""),
    "changed_constants": (changed_constants, f"""{WITH}, {LONG}, n AS (SELECT count(*) AS n FROM rx WHERE ion = 'Li'),
        li AS (SELECT idx, count(*) AS nz, sum(val) / max(n) AS mean, min(val) AS lo, max(val) AS hi, max(n) AS n FROM long, n WHERE ion = 'Li' GROUP BY 1),
        fixed AS (SELECT i AS idx, coalesce(mean, 0) AS mean FROM range(740) t(i) LEFT JOIN li ON li.idx = i WHERE mean IS NULL OR CASE WHEN nz < n THEN greatest(hi, 0) - least(lo, 0) ELSE hi - lo END <= 1e-12),
        hit AS (SELECT k, long.idx FROM long JOIN fixed ON fixed.idx = long.idx WHERE abs(val - mean) > 1e-9
          UNION ALL SELECT rx.k, fixed.idx FROM fixed JOIN rx ON mean <> 0 LEFT JOIN long ON long.k = rx.k AND long.idx = fixed.idx WHERE long.val IS NULL)
        SELECT k, count(*) AS changed FROM hit GROUP BY 1"""),
    "evaluation_reference": (evaluation_reference, f"""{_ROUTED}, {_MET}, t AS (SELECT *, CASE WHEN ion IN ('Na', 'K') THEN concat('held_out_', ion) ELSE 'holdout' END AS rl FROM sc)
        SELECT k AS request_id, CASE WHEN t.ion IN ('Na', 'K') THEN concat(rl, '_same_database') ELSE concat(t.population, '_grouped_holdout') END AS evaluation_scope, round(met.mae, 6) AS reference_mae,
        CASE WHEN t.ion NOT IN ('Na', 'K') THEN round(meti.mae, 6) END AS ion_mae FROM t LEFT JOIN met ON met.population = t.population AND met.family = t.family AND met.role = rl
        LEFT JOIN meti ON meti.population = t.population AND meti.family = t.family AND meti.role = rl AND meti.ion = t.ion"""),
    "model_catalog": (model_catalog, f"""{WITH}, {_MET}, b AS (SELECT population, mae FROM met WHERE family = 'median' AND role = 'holdout')
        SELECT met.population, family, family = {_DEF.format(p='met.population')} AS selected_by_cv, TRUE AS consistent, round(max(met.mae) FILTER (role = 'holdout'), 6) AS holdout_mae,
        round(max(met.mae) FILTER (role = 'held_out_Na'), 6) AS na_mae, round(max(met.mae) FILTER (role = 'held_out_K'), 6) AS k_mae, round(max(b.mae), 6) AS baseline_mae
        FROM met JOIN b ON b.population = met.population WHERE family <> 'median' GROUP BY 1, 2"""),
    "compare_results": (compare_results, """SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 19 = 0 THEN 'missing_right' ELSE concat_ws(';', CASE WHEN o_orderkey % 7 = 0 THEN 'differs_family' END,
        CASE WHEN o_orderkey % 5 = 0 THEN 'differs_prediction' END) END AS mismatches FROM orders WHERE o_orderkey % 19 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 5 = 0
        UNION ALL SELECT -o_orderkey - 1, 'missing_left' FROM orders WHERE o_orderkey % 19 = 0"""),
    "validate_predictions": (validate_predictions, """SELECT count(*) AS n_predictions, CAST(count_if(o_orderkey % 11 = 0) AS BIGINT) AS nonfinite_prediction, CAST(0 AS BIGINT) AS nonfinite_interval,
        CAST(count_if(o_orderkey % 13 = 0) AS BIGINT) AS loading_not_increasing, CAST(count_if(o_orderkey % 17 = 0) AS BIGINT) AS missing_model, CAST(count_if(o_orderkey % 19 = 0) AS BIGINT) AS missing_predictions,
        CAST(count_if(o_orderkey % 19 = 0) AS BIGINT) AS unexpected_predictions FROM orders"""),
    "export_scores": (export_scores, f"""{_ROUTED} SELECT CAST(k AS VARCHAR) AS request_id, ion AS working_ion, concat('Fe', a, '(PO4)', b) AS formula_charge, population, family,
        CAST(CAST(-ld AS DECIMAL(12, 3)) AS VARCHAR) AS minus_loading FROM sc"""),
    "states_to_intervals": (states_to_intervals, """WITH s AS (SELECT (event_id - event_id % 5) // 5 AS profile_id, event_id % 5 AS pos, event_type AS formula, value AS loading FROM events),
        n AS (SELECT profile_id, pos, formula AS formula_charge, loading AS loading_charge, lead(formula) OVER w AS formula_discharge, lead(loading) OVER w AS loading_discharge FROM s WINDOW w AS (PARTITION BY profile_id ORDER BY pos))
        SELECT * FROM n WHERE formula_discharge IS NOT NULL"""),
    "profile_contiguity": (profile_contiguity, f"""WITH {_IV} SELECT profile_id, pos, concat_ws(';', CASE WHEN ion <> first_value(ion) OVER w THEN 'different_working_ion' END, CASE WHEN fam <> first_value(fam) OVER w THEN 'different_model_family' END,
        CASE WHEN host <> first_value(host) OVER w THEN 'different_host' END, CASE WHEN pos > 0 AND abs(s - lag(t) OVER w) > 1e-9 * greatest(1, s, lag(t) OVER w) THEN 'gap_or_overlap' END,
        CASE WHEN pos > 0 AND e % 43 = 0 THEN 'shared_symmetry_differs' END, CASE WHEN count(*) OVER (PARTITION BY profile_id) NOT BETWEEN 2 AND 50 THEN 'interval_count' END) AS violations FROM iv WINDOW w AS (PARTITION BY profile_id ORDER BY pos)"""),
    "profile_steps": (profile_steps, f"""{_SCALE} SELECT profile_id, pos, round(64 + (s - x0) / (x1 - x0) * 632, 5) AS x1, round(64 + (t - x0) / (pr.x1 - x0) * 632, 5) AS x2,
        round(277 - (value - y0) / (y1 - y0) * 251, 5) AS y FROM iv JOIN pr USING (profile_id)"""),
    "profile_ticks": (profile_ticks, f"""{_SCALE} SELECT profile_id, 'x' AS axis, i AS tick, round(x0 + (x1 - x0) * i / 5, 5) AS tick_value, round(64 + CAST(i AS DOUBLE) / 5 * 632, 4) AS pixel FROM pr, range(6) r(i)
        UNION ALL SELECT profile_id, 'y', i, round(y0 + (y1 - y0) * i / 4, 5), round(277 - CAST(i AS DOUBLE) / 4 * 251, 4) FROM pr, range(5) r(i)"""),
}
