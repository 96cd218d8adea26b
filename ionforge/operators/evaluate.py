"""Metrics, grouped cross-validation summaries, selection and comparison."""

from pyspark.sql import functions as F

from ionforge.constants import REVIEW_HIGH, REVIEW_LOW
from ionforge.functions.values import is_finite
from ionforge.operators.preprocess import ALL, _other_scopes
from ionforge.operators.ranking import exact_median
from ionforge.operators.splits import shared_group_flags


def metric_columns(y="y", pred="prediction"):
    """n, MAE, RMSE, R2 and bias; a non-finite input is an error, an empty group gives nulls."""
    actual, guess = F.col(y), F.col(pred)
    good = is_finite(actual) & is_finite(guess)
    checked = F.when(good, guess - actual).when(actual.isNotNull() | guess.isNotNull(), F.raise_error(
        F.lit("metrics require finite values")).cast("double"))
    n, sse = F.count(checked), F.sum(checked * checked)
    sst = F.var_pop(F.when(checked.isNotNull(), actual)) * n
    return [n.alias("n"), F.avg(F.abs(checked)).alias("mae"), F.sqrt(F.avg(checked * checked)).alias("rmse"),
            F.when((n > 1) & (sst > 0), 1 - sse / sst).alias("r2"), F.avg(checked).alias("bias")]


def regression_metrics(rows, groups=(), y="y", pred="prediction"):
    return rows.groupBy(*groups).agg(*metric_columns(y, pred))


def median_baseline(rows, folds, y="y"):
    """Exact training median per scope: leave-one-fold-out, and all rows as scope -1."""
    return exact_median(rows.select("fold", F.col(y)), [], y, fold="fold", scopes=("scope", _other_scopes(folds)))


def median_oof(rows, folds, y="y"):
    """Out-of-fold baseline predictions (the scope table has folds + 1 rows)."""
    medians = median_baseline(rows, folds, y).select(F.col("scope").alias("fold"), F.col("median").alias("prediction"))
    return rows.join(F.broadcast(medians), "fold")


def oof_coverage(rows, predictions, uid="row_uid", candidate="candidate"):
    """Per candidate: development rows never predicted, and rows predicted more than once."""
    seen = predictions.groupBy(candidate, uid).agg(F.count(F.lit(1)).alias("n"))
    total = rows.select(uid).distinct().agg(F.count(F.lit(1))).scalar()
    known = seen.join(rows.select(uid), uid, "left_semi")
    return known.groupBy(candidate).agg((total - F.count(F.lit(1))).alias("missing_rows"),
                                        F.count_if(F.col("n") > 1).alias("repeated_rows"))


def cv_summary(predictions, keys=("candidate",), fold="fold", y="y", pred="prediction"):
    """Mean and sample deviation of fold MAE plus pooled out-of-fold metrics."""
    per_fold = regression_metrics(predictions, [*keys, fold], y, pred)
    folds = per_fold.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("folds"), F.avg("mae").alias("mean_mae"),
        F.when(F.count(F.lit(1)) > 1, F.stddev_samp("mae")).otherwise(0.0).alias("std_mae"))
    pooled = regression_metrics(predictions, keys, y, pred)
    return folds.join(pooled, list(keys))


def select_candidate(summaries, groups=(), candidate="candidate", score="mean_mae"):
    """Smallest mean MAE, ties by id; a missing or non-finite score is an error."""
    checked = F.when(is_finite(F.col(score)), F.col(score)).otherwise(
        F.raise_error(F.lit("selection needs finite results")).cast("double"))
    best = F.min(F.struct(checked.alias("score"), F.col(candidate).alias("id")))
    picked = summaries.groupBy(*groups).agg(best.alias("best"))
    return picked.select(*groups, F.col("best.id").alias(candidate), F.col("best.score").alias(score))


def subgroup_metrics(rows, development, groups=(), y="y", pred="prediction", ion="ion", role="role", group="group_id",
                     low=REVIEW_LOW, high=REVIEW_HIGH, spread=("row_uid",)):
    """Metrics of all rows, each ion, negative, out-of-bounds, and known or new group rows.

    Every row is expanded into the subgroups it belongs to; subgroups that a
    role always reports stay in the result when empty.  A held-out row whose
    group occurs in development is an error for the holdout role.
    """
    flagged = shared_group_flags(rows, development, group, "known", spread)
    leak = (F.col(role) == "holdout") & F.col("known")
    flagged = flagged.withColumn("known", F.when(leak, F.raise_error(F.lit("development and holdout share a group")).cast("boolean"))
                                 .otherwise(F.col("known")))
    transfer = F.col(role).startswith("held_out_")
    value = F.col(y)
    member = lambda name, test: F.struct(name.alias("subgroup"), test.alias("inside"))
    names = F.array(
        member(F.lit("all"), F.lit(True)), member(F.concat(F.lit("ion:"), F.col(ion)), F.lit(True)),
        member(F.lit("negative"), value < 0), member(F.lit("priority_review"), (value < low) | (value > high)),
        member(F.when(transfer, "known_group"), F.col("known")), member(F.when(transfer, "new_group"), ~F.col("known")))
    long = flagged.select(*groups, role, y, pred, F.inline(names)).where(F.col("subgroup").isNotNull())
    kept = long.withColumns({y: F.when(F.col("inside"), F.col(y)), pred: F.when(F.col("inside"), F.col(pred))})
    return regression_metrics(kept, [*groups, role, "subgroup"], y, pred)


def prediction_table(rows, development, y="y", pred="prediction", group="group_id", spread=("row_uid",)):
    seen = shared_group_flags(rows, development, group, "group_seen_in_development", spread)
    return seen.select("row_uid", F.col(group), "ion", "role", F.col(y).alias("reference"), F.col(pred).alias("predicted"),
                       F.abs(F.col(y) - F.col(pred)).alias("absolute_error"), "group_seen_in_development")


def model_comparison(selected, evaluation):
    """One row per selected model: CV scores, holdout metrics, transfer MAE.

    ``evaluation``: population, family, role, n, mae, rmse, r2 of subgroup "all".
    """
    at = lambda role, col: F.max(F.when(F.col("role") == role, F.col(col)))
    wide = evaluation.groupBy("population", "family").agg(
        at("holdout", "mae").alias("holdout_mae"), at("holdout", "rmse").alias("holdout_rmse"),
        at("holdout", "r2").alias("holdout_r2"), at("held_out_Na", "mae").alias("na_mae"), at("held_out_K", "mae").alias("k_mae"))
    return selected.join(wide, ["population", "family"], "left")


def resume_pending(grid, finished, keys=("population", "candidate", "fold"), digest="digest"):
    """Tasks without a verified finished state, in grid order."""
    return grid.join(finished.select(*keys, digest), [*keys, digest], "left_anti").orderBy(*keys)


def freeze_selection(selection, columns):
    """Order-free digest of a selection table, taken before any held-out data is read."""
    from ionforge.functions.keys import canonical_text, set_digest
    return selection.agg(set_digest(canonical_text(selection, columns)).alias("selection_digest"))


def check_frozen(selection, columns, frozen_digest):
    """Error when the selection no longer has the frozen digest."""
    now = freeze_selection(selection, columns)
    same = F.col("selection_digest") == F.lit(frozen_digest)
    return now.withColumn("unchanged", F.when(same, True).otherwise(
        F.raise_error(F.lit("frozen selection changed")).cast("boolean")))
