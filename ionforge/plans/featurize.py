"""Registered queries: the feature vector and fold-scoped preprocessing."""

from pyspark.sql import functions as F

from ionforge.operators import features, preprocess
from ionforge.operators.features import WIDTH
from ionforge.plans import flows
from ionforge.plans.fixtures import LONG, WITH, clean
from ionforge.session import stored


def _block(spark, sf, low, high):
    long = features.long_form(flows.vectors(spark, sf), ["k", "ion"])
    return long.where(F.col("idx").between(low, high))


def _per_column(rows):
    return rows.groupBy(F.col("idx")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("val"), 4).alias("total"),
                                          F.round(F.min("val"), 9).alias("low"), F.round(F.max("val"), 9).alias("high"))


def _rows(rows):
    return rows.select("k", "idx", F.round("val", 7).alias("val"))


def element_fractions(spark, sf):
    return _per_column(_block(spark, sf, 0, 235))


def composition_stats(spark, sf):
    return _rows(_block(spark, sf, 236, 249))


def ion_features(spark, sf):
    return _per_column(_block(spark, sf, 250, 259))


def interval_features(spark, sf):
    return _rows(_block(spark, sf, 260, 265))


def crystal_one_hot(spark, sf):
    return _per_column(_block(spark, sf, 266, 279))


def spacegroup_one_hot(spark, sf):
    return _per_column(_block(spark, sf, 280, 739))


def assemble_features(spark, sf):
    rows = flows.vectors(spark, sf)
    total = F.aggregate(F.arrays_zip("idx", "val"), F.lit(0.0), lambda acc, e: acc + (e["idx"] + 1) * e["val"])
    return rows.select("k", F.size("idx").alias("nonzeros"), F.round(total, 5).alias("checksum"))


def rejected_reactions(spark, sf):
    """First reason a reaction with injected faults gets no vector."""
    k = F.col("k")
    rows = clean(spark, sf).withColumns({
        "formula_discharge": F.when(k % 23 == 0, "Fe(OH").when(k % 29 == 0, F.col("formula_charge")).otherwise(F.col("formula_discharge")),
        "crystal_system_charge": F.when(k % 31 == 0, "none").otherwise(F.col("crystal_system_charge")),
        "fracA_discharge": F.when(k % 37 == 0, "0.9").otherwise(F.col("fracA_discharge"))})
    out = features.assemble_features(rows, ["k"]).where(F.col("reaction_error").isNotNull())
    return out.select("k", "reaction_error")


def feature_schema(spark, sf):
    """Column count of each block, with the non-zero entries the data has in it."""
    schema = features.feature_schema(spark)
    used = features.long_form(flows.vectors(spark, sf), ["k"]).groupBy("idx").agg(F.count(F.lit(1)).alias("n"))
    return schema.join(F.broadcast(used), "idx", "left").groupBy("block").agg(
        F.count(F.lit(1)).alias("columns"), F.count("n").alias("used_columns"), F.coalesce(F.sum("n"), F.lit(0)).alias("nonzeros"))


def _scope(df):
    return df.withColumn("scope", F.col("scope").cast("bigint"))


def varying_mask(spark, sf):
    return _scope(preprocess.varying_mask(flows.states(spark, sf)))


def fit_scaler(spark, sf):
    states = preprocess.fit_states(flows.embedding_vectors(spark, sf), 64, flows.FOLDS)
    return _scope(states).select("scope", "idx", "train_rows", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def fit_all_folds(spark, sf):
    """Scaler states of every scope on the reaction features."""
    return _scope(flows.states(spark, sf).where("active")).select("scope", "idx", "train_rows", F.round("mean", 5).alias("mean"), F.round("std", 4).alias("std"))


def transform_scaled(spark, sf):
    rows = flows.embedding_vectors(spark, sf)
    states = stored(preprocess.fit_states(rows, 64, flows.FOLDS), "embstates")
    scaled = preprocess.transform_scaled(rows.withColumn("scope", F.col("fold")), states, ["vec_id"], 64)
    return scaled.select("vec_id", "idx", F.round("scaled", 5).alias("scaled"))


def materialize_fold(spark, sf):
    return preprocess.materialize_fold(flows.vectors(spark, sf), flows.FOLDS).groupBy(F.col("scope").cast("bigint").alias("scope"), "side").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("y"), 4).alias("sum_y"))


def scope_guard(spark, sf):
    rows = flows.vectors(spark, sf)
    claimed = preprocess.training_digests(rows, flows.FOLDS).withColumn(
        "row_digest", F.when(F.col("scope") == 2, "0:0").otherwise(F.col("row_digest")))
    return _scope(preprocess.scope_guard(claimed, rows, flows.FOLDS)).select("scope", "train_rows", "row_digest", "overlap_groups", "valid")


def scope_audit(spark, sf):
    """Claims of both populations: one scope over other rows, one over other features, one missing, one that doesn't exist."""
    rows, own = flows.vectors(spark, sf).where("ion NOT IN ('Na', 'K')"), None
    for population, ions in flows.POPULATIONS.items():
        part = preprocess.scope_claims(rows if ions is None else rows.where(F.col("ion").isin(*ions)), flows.FOLDS, population, features.SCHEMA_HASH)
        own = part if own is None else own.unionByName(part)
    scope, mixed = F.col("scope"), F.col("population") == "mixed_ions"
    claimed = own.where(~(mixed & (scope == 3))).withColumns({
        "row_digest": F.when(mixed & (scope == 2), "0:0").otherwise(F.col("row_digest")),
        "feature_digest": F.when(~mixed & (scope == 1), "other").otherwise(F.col("feature_digest"))})
    claimed = claimed.unionByName(claimed.where(mixed & (scope == 0)).withColumn("scope", F.lit(9)))
    return _scope(preprocess.scope_audit(claimed, own))


def _two_column_model(spark, sf):
    rows = flows.once(spark, sf, "twocol", lambda: flows.two_columns(spark, sf))
    states = flows.once(spark, sf, "twocol-states", lambda: preprocess.fit_states(rows, 2, flows.FOLDS))
    pca = flows.once(spark, sf, "twocol-pca", lambda: preprocess.fit_pca(rows, states, 2, 2))
    return rows, states, pca


def fit_pca(spark, sf):
    pca = _two_column_model(spark, sf)[2]
    return pca.select(F.col("scope").cast("bigint").alias("scope"), F.col("component").cast("bigint").alias("component"), F.round("eigenvalue", 6).alias("eigenvalue"),
                      F.round(F.element_at("loading", 1) * F.element_at("loading", 1), 6).alias("squared_loading"))


def explained_variance(spark, sf):
    out = preprocess.explained_variance(_two_column_model(spark, sf)[2])
    return out.select(F.col("scope").cast("bigint").alias("scope"), F.col("component").cast("bigint").alias("component"),
                      F.round("ratio", 6).alias("ratio"), F.round("cumulative", 6).alias("cumulative"))


def transform_pca(spark, sf):
    rows, states, pca = _two_column_model(spark, sf)
    scored = preprocess.transform_pca(rows.withColumn("scope", F.col("fold")), states, pca, ["fold"], 2)
    sq = lambda i: F.round(F.sum(F.col("pca")[i] * F.col("pca")[i]), 2)
    return scored.groupBy(F.col("scope").cast("bigint").alias("scope")).agg(F.count(F.lit(1)).alias("n"), sq(0).alias("square_1"), sq(1).alias("square_2"))


def fit_pca_features(spark, sf):
    """Components of the full reaction features: trace and squared correlations against SQL, and unit orthogonal loadings."""
    vectors, states = flows.vectors(spark, sf), flows.states(spark, sf)
    pca = flows.once(spark, sf, "pca", lambda: preprocess.fit_pca(vectors, states, WIDTH, 80))
    a, b = pca.alias("a"), pca.select("scope", F.col("component").alias("other"), F.col("loading").alias("second")).alias("b")
    dot = F.aggregate(F.zip_with("loading", "second", lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)
    off = a.join(b, "scope").select("scope", F.abs(dot - F.when(F.col("component") == F.col("other"), 1.0).otherwise(0.0)).alias("off"))
    unit = off.groupBy("scope").agg((F.max("off") < 1e-9).alias("orthogonal"))
    whole = pca.groupBy("scope").agg(
        F.count("*").alias("components"), F.max(F.size("idx")).cast("bigint").alias("active"), F.round(F.avg(F.col("eigenvalue") / F.col("ratio")), 6).alias("trace"),
        F.round(F.max("squares"), 4).alias("squares"))
    return whole.join(unit, "scope").select(F.col("scope").cast("bigint").alias("scope"), "components", "active", "trace", "squares", "orthogonal")


def support_diagnostics(spark, sf):
    """Columns constant over the lithium rows that differ in sodium and potassium rows."""
    rows = flows.vectors(spark, sf)
    states = flows.once(spark, sf, "li-states", lambda: preprocess.fit_states(rows.where("ion = 'Li'"), WIDTH, flows.FOLDS))
    transfer = rows.where("ion IN ('Na', 'K')").withColumn("scope", F.lit(preprocess.ALL))
    changed = preprocess.support_diagnostics(transfer, states, ["row_uid", "ion"])
    return changed.groupBy("ion", "idx").agg(F.count(F.lit(1)).alias("n_rows"))


_COL = "idx, count(*) AS n, round(sum(val), 4) AS total, round(min(val), 9) AS low, round(max(val), 9) AS high FROM long WHERE idx BETWEEN {} AND {} GROUP BY 1"
_VAL = "k, idx, round(val, 7) AS val FROM long WHERE idx BETWEEN {} AND {}"
_FULL = f"{WITH}, {LONG}"
_SCOPES = "(SELECT unnest([0, 1, 2, 3, 4, -1])::BIGINT AS scope)"
_EMB = """WITH e AS (SELECT vec_id, CAST(vec_id % 5 AS INT) AS fold, CAST(unnest(range(64)) AS INT) AS idx, CAST(unnest(embedding) AS DOUBLE) AS val FROM embeddings),
  st AS (SELECT scope, idx, count(*) AS train_rows, avg(val) AS mean, stddev_pop(val) AS std FROM e, (SELECT unnest([0, 1, 2, 3, 4, -1])::BIGINT AS scope) s WHERE fold <> scope GROUP BY 1, 2)"""
_STATE = f"""{_FULL}, sc AS {_SCOPES}, nn AS (SELECT scope, count(*) AS n FROM rx, sc WHERE c % 5 <> scope GROUP BY 1),
  cm AS (SELECT scope, idx, count(*) AS nz, sum(val) AS s1, min(val) AS lo, max(val) AS hi FROM long, sc WHERE c % 5 <> scope GROUP BY 1, 2),
  base AS (SELECT scope, idx, n, nz, s1 / n AS mean, CASE WHEN nz < n THEN least(lo, 0) ELSE lo END AS lo, CASE WHEN nz < n THEN greatest(hi, 0) ELSE hi END AS hi FROM cm JOIN nn USING (scope)),
  act AS (SELECT * FROM base WHERE hi - lo > 1e-12)"""
_CORR = """WITH c AS (SELECT scope, corr(l_quantity, l_extendedprice) AS r, avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS mp, stddev_pop(l_extendedprice) AS sp
  FROM lineitem, (SELECT unnest([0, 1, 2, 3, 4, -1])::BIGINT AS scope) s WHERE l_linenumber % 5 <> scope GROUP BY 1)"""

QUERIES = {
    "element_fractions": (element_fractions, f"{_FULL} SELECT {_COL.format(0, 235)}"),
    "composition_stats": (composition_stats, f"{_FULL} SELECT {_VAL.format(236, 249)}"),
    "ion_features": (ion_features, f"{_FULL} SELECT {_COL.format(250, 259)}"),
    "interval_features": (interval_features, f"{_FULL} SELECT {_VAL.format(260, 265)}"),
    "crystal_one_hot": (crystal_one_hot, f"{_FULL} SELECT {_COL.format(266, 279)}"),
    "spacegroup_one_hot": (spacegroup_one_hot, f"{_FULL} SELECT {_COL.format(280, 739)}"),
    "assemble_features": (assemble_features, f"{_FULL} SELECT k, CAST(count(*) AS INT) AS nonzeros, round(sum((idx + 1) * val), 5) AS checksum FROM long GROUP BY 1"),
    "rejected_reactions": (rejected_reactions, f"""{WITH} SELECT k, CASE WHEN k % 31 = 0 THEN 'charge symmetry is inconsistent' WHEN k % 23 = 0 THEN 'discharge formula is invalid or has no host'
        WHEN k % 29 = 0 OR k % 37 = 0 THEN 'discharge atom fraction disagrees with its formula' END AS reaction_error FROM rx WHERE k % 31 = 0 OR k % 23 = 0 OR k % 29 = 0 OR k % 37 = 0"""),
    "feature_schema": (feature_schema, f"""{_FULL}, w AS (SELECT * FROM (VALUES ('endpoint_element_fractions', 0, 235), ('endpoint_composition_summaries', 236, 249), ('working_ion', 250, 259),
        ('concentration_interval', 260, 265), ('crystal_system', 266, 279), ('spacegroup', 280, 739)) t(block, lo, hi))
        SELECT block, CAST(hi - lo + 1 AS BIGINT) AS columns, count(DISTINCT idx) AS used_columns, count(*) AS nonzeros FROM w JOIN long ON idx BETWEEN lo AND hi GROUP BY block, lo, hi"""),
    "varying_mask": (varying_mask, f"{_STATE} SELECT scope, idx FROM act"),
    "fit_scaler": (fit_scaler, f"{_EMB} SELECT scope, idx, train_rows, round(mean, 6) AS mean, round(std, 6) AS std FROM st"),
    "fit_all_folds": (fit_all_folds, f"""{_STATE}, dv AS (SELECT scope, idx, sum((val - mean) ** 2) AS d2 FROM long JOIN act USING (idx) WHERE c % 5 <> scope GROUP BY 1, 2)
        SELECT scope, idx, n AS train_rows, round(mean, 5) AS mean, round(sqrt((d2 + (n - nz) * mean * mean) / n), 4) AS std FROM act JOIN dv USING (scope, idx)"""),
    "transform_scaled": (transform_scaled, f"{_EMB} SELECT vec_id, e.idx, round((val - mean) / std, 5) AS scaled FROM e JOIN st ON st.idx = e.idx AND st.scope = e.fold"),
    "materialize_fold": (materialize_fold, f"""{WITH} SELECT scope, CASE WHEN c % 5 = scope THEN 'validation' ELSE 'training' END AS side, count(*) AS n, round(sum(CAST(mv AS DOUBLE) / 1000), 4) AS sum_y
        FROM rx, (SELECT unnest([0, 1, 2, 3, 4])::BIGINT AS scope) s GROUP BY 1, 2"""),
    "scope_guard": (scope_guard, f"""{WITH}, d AS (SELECT scope, count(*) AS train_rows, concat(count(*), ':', sum(CAST(('0x' || substr(sha256(concat('u', k)), 1, 15)) AS BIGINT))) AS dig
        FROM rx, {_SCOPES} s WHERE c % 5 <> scope GROUP BY 1) SELECT scope, train_rows, CASE WHEN scope = 2 THEN '0:0' ELSE dig END AS row_digest, CAST(0 AS BIGINT) AS overlap_groups, scope <> 2 AS valid FROM d"""),
    "scope_audit": (scope_audit, f"""{WITH}, own AS (SELECT 'mixed_ions' AS population, c % 5 AS fold FROM rx WHERE ion NOT IN ('Na', 'K') UNION ALL SELECT 'li_only', c % 5 FROM rx WHERE ion = 'Li')
        SELECT population, scope, count(*) AS train_rows, CASE WHEN population = 'mixed_ions' AND scope = 2 THEN 'other_rows' WHEN population = 'mixed_ions' AND scope = 3 THEN 'unclaimed'
          WHEN population = 'li_only' AND scope = 1 THEN 'other_features' ELSE 'ok' END AS status FROM own, {_SCOPES} s WHERE fold <> scope GROUP BY 1, 2 UNION ALL SELECT 'mixed_ions', 9, NULL, 'unknown_scope'"""),
    "fit_pca": (fit_pca, f"{_CORR} SELECT scope, 0::BIGINT AS component, round(1 + abs(r), 6) AS eigenvalue, CAST(0.5 AS DOUBLE) AS squared_loading FROM c UNION ALL SELECT scope, 1, round(1 - abs(r), 6), 0.5 FROM c"),
    "explained_variance": (explained_variance, f"""{_CORR} SELECT scope, 0::BIGINT AS component, round((1 + abs(r)) / 2, 6) AS ratio, round((1 + abs(r)) / 2, 6) AS cumulative FROM c
        UNION ALL SELECT scope, 1, round((1 - abs(r)) / 2, 6), CAST(1 AS DOUBLE) FROM c"""),
    "transform_pca": (transform_pca, f"""{_CORR}, z AS (SELECT scope, (l_quantity - mq) / sq AS a, sign(r) * (l_extendedprice - mp) / sp AS b FROM lineitem JOIN c ON l_linenumber % 5 = scope)
        SELECT scope, count(*) AS n, round(sum((a + b) ** 2 / 2), 2) AS square_1, round(sum((a - b) ** 2 / 2), 2) AS square_2 FROM z GROUP BY 1"""),
    "fit_pca_features": (fit_pca_features, f"""{_STATE}, dv AS (SELECT scope, idx, sum((val - mean) ** 2) AS d2 FROM long JOIN act USING (idx) WHERE c % 5 <> scope GROUP BY 1, 2),
        sd AS (SELECT scope, idx, n, mean, sqrt((d2 + (n - nz) * mean * mean) / n) AS std FROM act JOIN dv USING (scope, idx)),
        pr AS (SELECT x.c % 5 AS fold, x.idx AS i, y.idx AS j, sum(x.val * y.val) AS s FROM long x JOIN long y ON x.k = y.k GROUP BY 1, 2, 3),
        ps AS (SELECT scope, i, j, sum(s) AS s FROM pr, sc WHERE fold <> scope GROUP BY 1, 2, 3),
        lone AS (SELECT scope, count(*) AS active, sum((mean / std) ** 2) ** 2 AS q FROM sd GROUP BY 1),
        both_in AS (SELECT scope, sum(((s / a.n - a.mean * b.mean) / (a.std * b.std)) ** 2 - (a.mean * b.mean / (a.std * b.std)) ** 2) AS q
          FROM ps JOIN sd a USING (scope) JOIN sd b USING (scope) WHERE a.idx = i AND b.idx = j GROUP BY 1)
        SELECT scope, 80::BIGINT AS components, active, round(active::DOUBLE, 6) AS trace, round(lone.q + both_in.q, 4) AS squares, TRUE AS orthogonal FROM lone JOIN both_in USING (scope)"""),
    "support_diagnostics": (support_diagnostics, f"""{_FULL}, n AS (SELECT count(*) AS n FROM rx WHERE ion = 'Li'),
        li AS (SELECT idx, count(*) AS nz, sum(val) / max(n) AS mean, min(val) AS lo, max(val) AS hi, max(n) AS n FROM long, n WHERE ion = 'Li' GROUP BY 1),
        cols AS (SELECT i AS idx, coalesce(mean, 0) AS mean FROM range(740) t(i) LEFT JOIN li ON li.idx = i
          WHERE mean IS NULL OR CASE WHEN nz < n THEN greatest(hi, 0) - least(lo, 0) ELSE hi - lo END <= 1e-12),
        tr AS (SELECT k, ion FROM rx WHERE ion IN ('Na', 'K')), v AS (SELECT k, idx, val FROM long WHERE ion IN ('Na', 'K'))
        SELECT ion, CAST(cols.idx AS INT) AS idx, count(*) AS n_rows FROM tr CROSS JOIN cols LEFT JOIN v ON v.k = tr.k AND v.idx = cols.idx WHERE abs(coalesce(val, 0) - mean) > 1e-9 GROUP BY 1, 2"""),
}
