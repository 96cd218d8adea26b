"""Registered queries: candidates, regressors, cross-validation and evaluation."""

from pyspark.sql import functions as F

from ionforge.functions.keys import set_digest
from ionforge.operators import evaluate, models
from ionforge.operators.features import WIDTH
from ionforge.plans import flows
from ionforge.plans.fixtures import LONG, WITH, rx, table
from ionforge.session import stored

def candidate_grid(spark, sf):
    """Tasks of the search for every (population, fold) present in the split."""
    rows = flows.split(spark, sf)
    used = (rows.where("mixed_cv_fold IS NOT NULL").select(F.lit("mixed_ions").alias("population"), F.col("mixed_cv_fold").alias("fold"))
            .unionByName(rows.where("li_cv_fold IS NOT NULL").select(F.lit("li_only").alias("population"), F.col("li_cv_fold").alias("fold"))).distinct())
    return models.candidate_grid(used).groupBy("population", "family", "representation").agg(F.count(F.lit(1)).alias("tasks"))


def gamma_scale(spark, sf):
    return models.gamma_scale(flows.vectors(spark, sf), ["ion"], WIDTH).select("ion", F.round("gamma", 9).alias("gamma"))


def target_transform(spark, sf):
    out = models.target_transform(flows.evaluated(spark, sf), flows.FOLDS)
    return out.select(F.col("scope").cast("bigint").alias("scope"), F.round("offset", 6).alias("offset"), F.round("scale", 6).alias("scale"))


def linear_ridge(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_linenumber") % 5).cast("int").alias("fold"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    out = models.linear_ridge(rows, flows.FOLDS, "x", "y", 10.0)
    return out.select(F.col("scope").cast("bigint").alias("scope"), F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"))


def _medians(rows):
    """Error of the out-of-fold median of every population."""
    found = None
    for population, ions in flows.POPULATIONS.items():
        own = rows if ions is None else rows.where(F.col("ion").isin(*ions))
        part = evaluate.regression_metrics(evaluate.median_oof(own, flows.FOLDS)).select(F.lit(population).alias("population"), F.col("mae").alias("median_mae"))
        found = part if found is None else found.unionByName(part)
    return found


def _family(spark, sf, family):
    """Cross-validation of all candidates of a family in both populations, run where it isn't finished."""
    found = flows.search(spark, sf)
    found.run([family])
    scores = stored(found.summary([family]), "family-scores")
    best = scores.groupBy("population").agg(F.min("mae").alias("least")).join(_medians(flows.development(spark, sf)), "population")
    best = best.select("population", (F.col("least") < 0.8 * F.col("median_mae")).alias("family_better"))
    return scores.join(best, "population").select("population", "candidate", "folds", "n", "missing_rows", "repeated_rows", "family_better")


def rbf_ridge(spark, sf):
    return _family(spark, sf, "krr")


def rbf_eps_regression(spark, sf):
    return _family(spark, sf, "svr")


def tree_regression(spark, sf):
    return _family(spark, sf, "tree")


def model_search(spark, sf):
    """The whole search: what was run, covered and chosen, by population and family."""
    found = flows.search(spark, sf)
    found.run()
    summary = stored(found.summary().join(_medians(flows.development(spark, sf)), "population"), "search-summary")
    chosen = found.select(summary)
    rows = summary.join(chosen.select("population", "family", F.col("candidate").alias("chosen"), F.col("mean_mae").alias("least"), "selected"), ["population", "family"])
    per_family = rows.groupBy("population", "family").agg(
        F.count("*").alias("candidates"), F.sum("folds").alias("tasks"), F.sum("n").alias("predictions"),
        (F.sum("missing_rows") + F.sum("repeated_rows")).alias("uncovered"), F.bool_or(F.col("mae") < 0.8 * F.col("median_mae")).alias("better"),
        F.bool_and(F.col("mean_mae") >= F.col("least")).alias("least_chosen"), F.count_if(F.col("selected")).alias("selected"))
    total = per_family.groupBy("population").agg(F.count_if(F.col("selected") > 0).alias("families_selected"))
    return per_family.drop("selected").join(total, "population")


def search_resume(spark, sf):
    """Tasks that are open after the search, and those that open when a row of fold 0 is missing from its rows."""
    found = flows.search(spark, sf)
    found.run()
    rows = flows.development(spark, sf)
    first = rows.where("fold = 0 AND ion = 'Li'").agg(F.min("row_uid")).first()[0]
    changed = found.over(flows.stored_without(rows, first))
    one = lambda s, name: s.pending().groupBy("population").agg(F.count("*").alias(name))
    tasks = found.tasks().groupBy("population").agg(F.count("*").alias("tasks"))
    filled = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return tasks.join(one(found, "open"), "population", "left").join(one(changed, "reopened"), "population", "left").select("population", "tasks", filled("open"), filled("reopened"))


def model_evaluation(spark, sf):
    """Rows and metrics of the final models on held-out rows, by subgroup; the choice is frozen before."""
    metrics = flows.final(spark, sf)
    return metrics.select("population", "family", "role", "subgroup", "n", (F.col("n") == 0).alias("empty"), (F.coalesce("rmse", F.lit(0.0)) >= F.coalesce("mae", F.lit(0.0))).alias("sound"))


def predict(spark, sf):
    """Linear scores of every reaction vector."""
    rows = flows.vectors(spark, sf).withColumns({"population": F.when(F.col("ion").isin("Li", "Na", "K"), "li_only").otherwise("mixed_ions"), "family": F.lit("krr")})
    return models.linear_predict(rows, flows.linear_models(spark), ["population", "family"]).select("k", "population", F.round("prediction", 6).alias("prediction"))


def regression_metrics(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("y"), (1500 * F.col("l_quantity")).alias("prediction"))
    return evaluate.regression_metrics(rows, ["l_returnflag"]).select("l_returnflag", "n", *[F.round(c, 5).alias(c) for c in ("mae", "rmse", "r2", "bias")])


def _prices(spark, sf):
    return table(spark, sf, "orders").select(F.concat(F.lit("u"), "o_orderkey").alias("row_uid"), (F.col("o_custkey") % 5).cast("int").alias("fold"), F.col("o_totalprice").alias("y"))


def median_baseline(spark, sf):
    return evaluate.median_baseline(_prices(spark, sf), flows.FOLDS).select(F.col("scope").cast("bigint").alias("scope"), F.round("median", 4).alias("median"))


def oof_predictions(spark, sf):
    rows = _prices(spark, sf)
    return evaluate.median_oof(rows, flows.FOLDS).select("row_uid", F.round("prediction", 4).alias("prediction"))


def oof_coverage(spark, sf):
    """A complete baseline candidate, and one that misses a fold and repeats another."""
    rows = _prices(spark, sf)
    whole = evaluate.median_oof(rows, flows.FOLDS).select("row_uid", "fold", F.lit("median").alias("candidate"))
    broken = whole.where("fold <> 1").withColumn("candidate", F.lit("broken"))
    return evaluate.oof_coverage(rows, whole.unionByName(broken).unionByName(broken.where("fold = 3")))


def _candidates(spark, sf):
    rows = flows.evaluated(spark, sf).where("role = 'development'").select("row_uid", "ion", "fold", "y", "prediction")
    entry = lambda name, p: F.struct(F.lit(name).alias("candidate"), p.alias("prediction"))
    return rows.select("row_uid", "ion", "fold", "y", F.inline(F.array(
        entry("a_linear", F.col("prediction")), entry("b_constant", F.lit(4.5)), entry("c_constant", F.lit(4.625)), entry("d_shift", F.col("prediction") + F.col("fold")))))


def cv_summary(spark, sf):
    return evaluate.cv_summary(_candidates(spark, sf)).select("candidate", "folds", "n", *[F.round(c, 6).alias(c) for c in ("mean_mae", "std_mae")], *[flows.nudged(c) for c in ("mae", "rmse", "r2", "bias")])


def select_candidate(spark, sf):
    rows = _candidates(spark, sf)
    return evaluate.select_candidate(evaluate.cv_summary(rows, ["ion", "candidate"]), ["ion"]).select("ion", "candidate", F.round("mean_mae", 6).alias("mean_mae"))


def _held(spark, sf):
    rows = flows.evaluated(spark, sf)
    return rows.where("role <> 'development'"), rows.where("role = 'development'")


def subgroup_metrics(spark, sf):
    out = evaluate.subgroup_metrics(*_held(spark, sf))
    return out.select("role", "subgroup", "n", *[flows.nudged(c) for c in ("mae", "rmse", "r2", "bias")])


def prediction_table(spark, sf):
    out = evaluate.prediction_table(*_held(spark, sf))
    return out.withColumn("absolute_error", F.round("absolute_error", 6))


def model_comparison(spark, sf):
    held, dev = _held(spark, sf)
    grown = held.select("*", F.inline(F.array(*[F.struct(F.lit(p).alias("population"), F.lit(f).alias("family")) for p, f in (("mixed_ions", "krr"), ("mixed_ions", "svr"), ("li_only", "krr"))])))
    metrics = evaluate.regression_metrics(grown.withColumn("prediction", F.col("prediction") + F.length("family") / 4 + F.when(F.col("population") == "li_only", 1).otherwise(0)), ["population", "family", "role"])
    summary = evaluate.regression_metrics(dev, ["fold"]).agg(F.avg("mae").alias("cv_mean_mae"))
    selected = metrics.select("population", "family").distinct().withColumn("cv_mean_mae", summary.scalar())
    out = evaluate.model_comparison(selected, metrics)
    return out.select("population", "family", F.round("cv_mean_mae", 6).alias("cv_mean_mae"), *[flows.nudged(c) for c in ("holdout_mae", "holdout_rmse", "holdout_r2", "na_mae", "k_mae")])


def resume_pending(spark, sf):
    """Customers as tasks: each has a finished state with the digest of its rows, many of them stale."""
    orders = table(spark, sf, "orders")
    tasks = orders.groupBy(F.col("o_custkey").alias("task")).agg(set_digest(F.concat(F.lit("u"), "o_orderkey")).alias("digest"))
    stale = (F.col("task") % 2 == 1) | (F.col("task") % 10 == 0)
    finished = tasks.withColumn("digest", F.when(stale, "stale").otherwise(F.col("digest")))
    return evaluate.resume_pending(tasks, finished, ["task"]).select("task")


def freeze_selection(spark, sf):
    chosen = evaluate.select_candidate(evaluate.cv_summary(_candidates(spark, sf), ["ion", "candidate"]), ["ion"]).select("ion", "candidate")
    digest = evaluate.freeze_selection(chosen, ["ion", "candidate"]).first()["selection_digest"]
    return evaluate.check_frozen(chosen, ["ion", "candidate"], digest)


_EV = f"{WITH}, {flows.EVALUATED}"
_CAND = f"""{_EV}, cd AS (SELECT row_uid, ion, fold, y, 'a_linear' AS candidate, prediction FROM ev WHERE role = 'development' UNION ALL SELECT row_uid, ion, fold, y, 'b_constant', 4.5 FROM ev WHERE role = 'development'
  UNION ALL SELECT row_uid, ion, fold, y, 'c_constant', 4.625 FROM ev WHERE role = 'development' UNION ALL SELECT row_uid, ion, fold, y, 'd_shift', prediction + fold FROM ev WHERE role = 'development')"""
_SEL = f"""{_CAND}, pf AS (SELECT ion, candidate, fold, avg(abs(prediction - y)) AS mae FROM cd GROUP BY 1, 2, 3), sm AS (SELECT ion, candidate, avg(mae) AS mean_mae FROM pf GROUP BY 1, 2),
  pick AS (SELECT *, row_number() OVER (PARTITION BY ion ORDER BY mean_mae, candidate) AS r FROM sm)"""
_S6 = "(SELECT unnest([0, 1, 2, 3, 4, -1])::BIGINT AS scope) s"
_SUB = f"""{_EV}, held AS (SELECT *, group_id IN (SELECT group_id FROM ev WHERE role = 'development') AS known FROM ev WHERE role <> 'development'),
  grp AS (SELECT role, 'all' AS subgroup, y, prediction FROM held UNION ALL SELECT role, concat('ion:', ion), y, prediction FROM held
    UNION ALL SELECT role, 'negative', CASE WHEN y < 0 THEN y END, CASE WHEN y < 0 THEN prediction END FROM held
    UNION ALL SELECT role, 'priority_review', CASE WHEN y < -3 OR y > 10 THEN y END, CASE WHEN y < -3 OR y > 10 THEN prediction END FROM held
    UNION ALL SELECT role, 'known_group', CASE WHEN known THEN y END, CASE WHEN known THEN prediction END FROM held WHERE role LIKE 'held_out_%'
    UNION ALL SELECT role, 'new_group', CASE WHEN NOT known THEN y END, CASE WHEN NOT known THEN prediction END FROM held WHERE role LIKE 'held_out_%')"""
_METRICS = flows.METRICS.replace("count(*)", "count(y)")

# Development rows by population; integers only, as counts need no target.
_DEV = f"""{WITH}, own AS (SELECT ion, c % 5 AS fold FROM rx WHERE ion NOT IN ('Na', 'K') AND c % 10 <> 0),
  dev AS (SELECT 'mixed_ions' AS population, fold FROM own UNION ALL SELECT 'li_only', fold FROM own WHERE ion = 'Li')"""


def _family_sql(family, count):
    """Rows, folds and coverage of every candidate of a family; the best of them is well below the median's error."""
    names = [c["id"] for c in models.candidates() if c["family"] == family]
    assert len(names) == count
    values = ", ".join(f"('{n}')" for n in names)
    return f"""{_DEV} SELECT population, candidate, count(DISTINCT fold)::BIGINT AS folds, count(*)::BIGINT AS n, 0::BIGINT AS missing_rows, 0::BIGINT AS repeated_rows, TRUE AS family_better
        FROM dev, (VALUES {values}) t(candidate) GROUP BY population, candidate"""


QUERIES = {
    "candidate_grid": (candidate_grid, """SELECT population, family, representation, (10 * candidates)::BIGINT AS tasks FROM (VALUES ('mixed_ions'), ('li_only')) p(population),
        (VALUES ('svr', 'pca', 3), ('svr', 'scaled', 3), ('krr', 'pca', 3), ('krr', 'scaled', 3), ('tree', 'raw', 2)) f(family, representation, candidates) WHERE (SELECT count(*) FROM orders) > 0"""),
    "gamma_scale": (gamma_scale, f"""{WITH}, {LONG}, n AS (SELECT ion, count(*) * 740 AS cells FROM rx GROUP BY 1)
        SELECT ion, round(1 / (740 * (sum(val * val) / max(cells) - (sum(val) / max(cells)) ** 2)), 9) AS gamma FROM long JOIN n USING (ion) GROUP BY 1"""),
    "target_transform": (target_transform, f"{_EV} SELECT scope, round(avg(y), 6) AS offset, round(stddev_pop(y), 6) AS scale FROM ev, {_S6} WHERE fold <> scope GROUP BY 1"),
    "linear_ridge": (linear_ridge, f"""WITH t AS (SELECT scope, covar_pop(l_quantity, l_extendedprice) * count(*) / (var_pop(l_quantity) * count(*) + 10) AS slope, avg(l_extendedprice) AS my, avg(l_quantity) AS mx
        FROM lineitem, {_S6} WHERE l_linenumber % 5 <> scope GROUP BY 1) SELECT scope, round(slope, 4) AS slope, round(my - slope * mx, 3) AS intercept FROM t"""),
    "rbf_ridge": (rbf_ridge, _family_sql("krr", 6)),
    "rbf_eps_regression": (rbf_eps_regression, _family_sql("svr", 6)),
    "tree_regression": (tree_regression, _family_sql("tree", 2)),
    "model_search": (model_search, f"""{_DEV}, g AS (SELECT * FROM (VALUES ('krr', 6), ('svr', 6), ('tree', 2)) t(family, candidates))
        SELECT population, family, candidates::BIGINT AS candidates, (candidates * 5)::BIGINT AS tasks, (candidates * count(*))::BIGINT AS predictions, 0::BIGINT AS uncovered,
          TRUE AS better, TRUE AS least_chosen, 1::BIGINT AS families_selected FROM dev, g GROUP BY population, family, candidates"""),
    "search_resume": (search_resume, f"""{_DEV} SELECT population, (14 * count(DISTINCT fold))::BIGINT AS tasks, 0::BIGINT AS open, (14 * (count(DISTINCT fold) - 1))::BIGINT AS reopened FROM dev GROUP BY population"""),
    "model_evaluation": (model_evaluation, f"""{_SUB.replace(flows.EVALUATED, flows.MODELLED)}, m AS (SELECT * FROM (VALUES ('krr'), ('svr'), ('tree')) f(family), (VALUES ('mixed_ions'), ('li_only')) p(population))
        SELECT population, family, role, subgroup, count(y)::BIGINT AS n, count(y) = 0 AS empty, TRUE AS sound FROM grp, m GROUP BY ALL"""),
    "predict": (predict, f"""{WITH} SELECT k, CASE WHEN ion IN ('Li', 'Na', 'K') THEN 'li_only' ELSE 'mixed_ions' END AS population, round(CASE WHEN ion IN ('Li', 'Na', 'K') THEN 1.5 + 0.25 * per + 0.5 * ld + oxy
        ELSE 9.0 - 0.25 * per + ld - 0.5 * oxy END, 6) AS prediction FROM (SELECT *, CASE ion WHEN 'Li' THEN 2 WHEN 'Na' THEN 3 WHEN 'Mg' THEN 3 WHEN 'Al' THEN 3 WHEN 'Y' THEN 5 ELSE 4 END AS per,
        CAST(m AS DOUBLE) / gcd(a, b) AS ld, CAST(4 * b AS DOUBLE) / (a + 5 * b) AS oxy FROM rx)"""),
    "regression_metrics": (regression_metrics, """WITH t AS (SELECT l_returnflag, l_extendedprice AS y, 1500 * l_quantity AS p FROM lineitem) SELECT l_returnflag, count(*) AS n, round(avg(abs(p - y)), 5) AS mae,
        round(sqrt(avg((p - y) ** 2)), 5) AS rmse, round(1 - sum((p - y) ** 2) / (var_pop(y) * count(*)), 5) AS r2, round(avg(p - y), 5) AS bias FROM t GROUP BY 1"""),
    "median_baseline": (median_baseline, f"SELECT scope, round(median(o_totalprice), 4) AS median FROM orders, {_S6} WHERE o_custkey % 5 <> scope GROUP BY 1"),
    "oof_predictions": (oof_predictions, f"""WITH m AS (SELECT scope, median(o_totalprice) AS med FROM orders, {_S6} WHERE o_custkey % 5 <> scope GROUP BY 1)
        SELECT concat('u', o_orderkey) AS row_uid, round(med, 4) AS prediction FROM orders JOIN m ON scope = o_custkey % 5"""),
    "oof_coverage": (oof_coverage, """SELECT 'median' AS candidate, 0::BIGINT AS missing_rows, 0::BIGINT AS repeated_rows
        UNION ALL SELECT 'broken', count(*) FILTER (o_custkey % 5 = 1), count(*) FILTER (o_custkey % 5 = 3) FROM orders"""),
    "cv_summary": (cv_summary, f"""{_CAND}, pf AS (SELECT candidate, fold, avg(abs(prediction - y)) AS mae FROM cd GROUP BY 1, 2), f AS (SELECT candidate, count(*) AS folds, round(avg(mae), 6) AS mean_mae, round(stddev_samp(mae), 6) AS std_mae FROM pf GROUP BY 1),
        m AS (SELECT candidate, {flows.METRICS} FROM cd GROUP BY 1) SELECT candidate, folds, n, mean_mae, std_mae, mae, rmse, r2, bias FROM f JOIN m USING (candidate)"""),
    "select_candidate": (select_candidate, f"{_SEL} SELECT ion, candidate, round(mean_mae, 6) AS mean_mae FROM pick WHERE r = 1"),
    "subgroup_metrics": (subgroup_metrics, f"{_SUB} SELECT role, subgroup, {_METRICS} FROM grp GROUP BY 1, 2"),
    "prediction_table": (prediction_table, f"""{_EV} SELECT row_uid, group_id, ion, role, y AS reference, prediction AS predicted, round(abs(y - prediction), 6) AS absolute_error,
        group_id IN (SELECT group_id FROM ev WHERE role = 'development') AS group_seen_in_development FROM ev WHERE role <> 'development'"""),
    "model_comparison": (model_comparison, f"""{_EV}, g AS (SELECT role, population, family, y, prediction + 0.75 + CASE WHEN population = 'li_only' THEN 1 ELSE 0 END AS prediction FROM ev,
          (VALUES ('mixed_ions', 'krr'), ('mixed_ions', 'svr'), ('li_only', 'krr')) t(population, family) WHERE role <> 'development'),
        m AS (SELECT population, family, role, {flows.METRICS} FROM g GROUP BY 1, 2, 3), c AS (SELECT round(avg(mae), 6) AS cv FROM (SELECT fold, avg(abs(prediction - y)) AS mae FROM ev WHERE role = 'development' GROUP BY 1))
        SELECT population, family, max(cv) AS cv_mean_mae, max(mae) FILTER (role = 'holdout') AS holdout_mae, max(rmse) FILTER (role = 'holdout') AS holdout_rmse, max(r2) FILTER (role = 'holdout') AS holdout_r2,
        max(mae) FILTER (role = 'held_out_Na') AS na_mae, max(mae) FILTER (role = 'held_out_K') AS k_mae FROM m, c GROUP BY 1, 2"""),
    "resume_pending": (resume_pending, "SELECT DISTINCT o_custkey AS task FROM orders WHERE o_custkey % 2 = 1 OR o_custkey % 10 = 0"),
    "freeze_selection": (freeze_selection, f"""{_SEL}, t AS (SELECT concat('candidate=s', length(candidate), ':', candidate, ';ion=s', length(ion), ':', ion, ';') AS x FROM pick WHERE r = 1)
        SELECT concat(count(*), ':', sum(CAST(('0x' || substr(sha256(x), 1, 15)) AS BIGINT))) AS selection_digest, TRUE AS unchanged FROM t"""),
}
