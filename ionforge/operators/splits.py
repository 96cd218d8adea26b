"""Leak-free holdouts, balanced group folds and overlap audits."""

from itertools import islice

import pyarrow as pa
from pyspark.sql import functions as F

from ionforge.constants import CORE_IONS, SIDES, TRANSFER_IONS, SplitSettings
from ionforge.functions.keys import seeded_hash
from ionforge.operators.ranking import bucket_levels, hash_rank
from ionforge.operators.skew import attach
from ionforge.session import stored

OVERLAP_KINDS = (("group", ("group_id",)), ("record", ("record_key",)),
                 ("endpoint", ("id_charge", "id_discharge")), ("host", ("canonical_host",)))


def hash_holdout(groups, settings=SplitSettings(), group="group_id"):
    """Distinct groups with ``held``: the first ceil(fraction * groups) by seeded hash.

    Fails when nothing or everything would be held out.
    """
    groups = groups.select(group).distinct()
    hashed = groups.withColumn("__hash", seeded_hash(settings.seed, "holdout", F.col(group)))
    total = groups.agg(F.count(F.lit(1))).scalar()
    quota = F.ceil(F.lit(settings.holdout_fraction) * total.cast("double"))
    held = F.when(quota >= total, F.raise_error(F.lit("not enough groups for development and holdout")).cast("boolean")) \
        .otherwise(F.col("rank") < quota)
    return hash_rank(hashed, "__hash").select(group, held.alias("held"))


def fill_classes(classes, folds):
    """Closed form of largest-first greedy filling: (size, segments) for every size class.

    ``classes`` yields (size, groups) by falling size.  Within a class the
    lowest folds take turns in a fixed order until the next fold's level is
    reached, so a class needs at most ``folds`` segments (start rank, fold
    order). All that is kept between classes are the folds' totals.
    """
    totals, counts = [0] * folds, [0] * folds
    for size, remaining in classes:
        start, segments = 0, []
        while remaining:
            order = sorted(range(folds), key=lambda f: (totals[f], counts[f], f))
            low = order[0]
            limit = (totals[low] + size, counts[low] + 1, low)
            turn = [f for f in order if (totals[f], counts[f], f) < limit]
            if len(turn) == folds:
                taken = remaining
            else:
                nxt = order[len(turn)]
                rounds = (totals[nxt] - totals[low]) // size
                if totals[low] + rounds * size == totals[nxt] and (counts[nxt], nxt) < (counts[low] + rounds, low):
                    rounds -= 1
                taken = min(remaining, rounds * len(turn))
            segments.append((start, turn))
            full, part = divmod(taken, len(turn))
            for i, f in enumerate(turn):
                picks = full + (i < part)
                totals[f] += picks * size
                counts[f] += picks
            start += taken
            remaining -= taken
        yield size, segments


def fill_plan(size_counts, folds):
    """``fill_classes`` of a list as a dictionary."""
    return dict(fill_classes(sorted(size_counts, reverse=True), folds))


def filled(classes, folds):
    """The plan of a class table (``__size, n``) as a table: one task streams it by falling size, K totals at hand.

    Sizes add up to the row count, so there are at most sqrt(2 * rows) classes.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("turn", pa.list_(pa.int32()))]))

    def run(batches):
        def rows():
            for batch in batches:
                yield from zip(batch.column("__size").to_pylist(), batch.column("n").to_pylist())

        plan = fill_classes(rows(), folds)
        while part := list(islice(plan, 1000)):
            segments = [[{"start": start, "turn": turn} for start, turn in own] for _, own in part]
            yield pa.RecordBatch.from_arrays([pa.array([size for size, _ in part], pa.int64()), pa.array(segments, kind)], ["__size", "__plan"])

    ordered = classes.repartitionByRange(1, F.desc("__size")).sortWithinPartitions(F.desc("__size"))
    return ordered.mapInArrow(run, "__size bigint, __plan array<struct<start:bigint,turn:array<int>>>")


def balanced_group_folds(rows, salt, settings=SplitSettings(), group="group_id", out="fold"):
    """One fold per group: largest first, always to the least filled fold."""
    k = settings.cv_folds
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("__size"))
    classes = stored(sizes.groupBy("__size").agg(F.count(F.lit(1)).alias("n")), "size-classes")
    groups = classes.agg(F.sum("n")).first()[0] or 0
    if groups < k:
        raise ValueError(f"{salt}: fewer groups than requested folds")
    ranked = hash_rank(sizes.withColumn("__hash", seeded_hash(settings.seed, salt, F.col(group))), "__hash",
                       "__rank", within=["__size"], levels=bucket_levels(groups))
    segment = F.element_at(F.filter("__plan", lambda s: s["start"] <= F.col("__rank")), -1)
    offset = ((F.col("__rank") - F.col("__seg.start")) % F.size("__seg.turn")).cast("int")
    return (ranked.join(stored(filled(classes, k), "fold-plan"), "__size").withColumn("__seg", segment)
            .select(group, F.col("__seg.turn")[offset].alias(out), F.col("__size").alias("group_rows")))


def _flag_groups(rows, groups, group, value, spread):
    """Left-join per-group values to rows with the row count per group as skew guide."""
    sized = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return attach(rows, sized.join(groups, group), [group], value, spread)


def shared_group_flags(rows, development, group="group_id", out="shares_group", spread=("row_uid",)):
    """True when the row's group occurs in the development rows."""
    seen = development.select(group).distinct().withColumn("__seen", F.lit(True))
    return _flag_groups(rows, seen, group, ["__seen"], spread).withColumn(out, F.coalesce("__seen", F.lit(False))).drop("__seen")


def assign_partitions(rows, settings=SplitSettings(), spread=("row_uid",)):
    """Partition, folds and transfer overlap flags for every validated, grouped row.

    ``rows`` should be a stored table: it is read by the holdout, both fold
    populations and the final join.
    """
    ion, ok = F.col("working_ion"), F.col("eligible_for_baseline")
    core = rows.where(ok & ion.isin(*CORE_IONS))
    held = stored(hash_holdout(core, settings), "held")
    dev = core.join(held.where("not held"), "group_id", "left_semi")
    mixed = balanced_group_folds(dev, "mixed_cv", settings, out="mixed").select("group_id", "mixed")
    li = balanced_group_folds(dev.where(ion == "Li"), "li_cv", settings, out="li").select("group_id", "li")
    per_group = stored(held.join(mixed, "group_id", "left").join(li, "group_id", "left"), "group-folds")
    joined = _flag_groups(rows, per_group, "group_id", ["held", "mixed", "li"], spread)
    is_transfer = ok & ion.isin(*TRANSFER_IONS)
    partition = (F.when(~ok, "quarantine").when(ion.isin(*TRANSFER_IONS), F.concat(F.lit("held_out_"), ion))
                 .when(F.col("held"), "holdout").otherwise("development"))
    is_dev = F.col("partition") == "development"
    return joined.withColumn("partition", partition).withColumns({
        "mixed_cv_fold": F.when(is_dev, F.col("mixed")),
        "li_cv_fold": F.when(is_dev & (ion == "Li"), F.col("li")),
        "shares_group_with_mixed_development": F.when(is_transfer, F.col("mixed").isNotNull()),
        "shares_group_with_li_development": F.when(is_transfer, F.col("li").isNotNull()),
    }).drop("held", "mixed", "li")


def _tokens(rows, keep, kinds=OVERLAP_KINDS):
    entries = [F.struct(F.lit(kind).alias("kind"), F.col(c).alias("token")) for kind, cols in kinds for c in cols]
    return rows.select(*keep, F.inline(F.array(*entries))).where(F.col("token") != "")


def overlap_counts(rows, side, kinds=OVERLAP_KINDS):
    """Tokens of each kind found on both sides (``side`` is a boolean column name)."""
    both = (_tokens(rows, [side], kinds).groupBy("kind", "token")
            .agg(F.bool_or(side).alias("l"), F.bool_or(~F.col(side)).alias("r")))
    return both.groupBy("kind").agg(F.count_if(F.col("l") & F.col("r")).alias("shared"))


def fold_overlap_counts(rows, fold, folds, kinds=OVERLAP_KINDS):
    """Per fold and kind: tokens the fold shares with any other fold, in one pass.

    A token is summarised by the set of folds it occurs in: at most ``folds`` small numbers.
    """
    fold_set = F.collect_set(F.col(fold).cast("int"))
    spans = (_tokens(rows.where(F.col(fold).between(0, folds - 1)), [fold], kinds).groupBy("kind", "token")
             .agg(fold_set.alias("folds")).where(F.size("folds") > 1))
    return spans.select("kind", F.explode("folds").alias("fold")).groupBy("fold", "kind").agg(F.count(F.lit(1)).alias("shared"))


def cv_leakage_audit(rows, fold, population, settings=SplitSettings(), kinds=OVERLAP_KINDS):
    """One row per fold: sizes of both sides and shared tokens of every kind (all must be 0)."""
    dev = rows.where(F.col("partition") == "development").where(F.col(fold).isNotNull())
    k = settings.cv_folds
    sizes = dev.groupBy(F.col(fold).cast("int").alias("fold")).agg(F.count(F.lit(1)).alias("validation_rows"))
    total = dev.agg(F.count(F.lit(1))).scalar()
    grid = rows.sparkSession.range(k).select(F.col("id").cast("int").alias("fold"))
    shared = (fold_overlap_counts(dev, fold, k, kinds).groupBy("fold")
              .pivot("kind", [kind for kind, _ in kinds]).agg(F.first("shared")))
    out = grid.join(sizes, "fold", "left").join(shared, "fold", "left")
    n = F.coalesce("validation_rows", F.lit(0))
    return out.select(F.lit(population).alias("population"), "fold", (total - n).alias("train_rows"), n.alias("validation_rows"),
                      *[F.coalesce(kind, F.lit(0)).cast("bigint").alias(f"shared_{kind}") for kind, _ in kinds])


def assert_no_leakage(audit):
    """Turn an audit into an error on the first leak or empty side."""
    shared = sum((F.col(c) for c in audit.columns if c.startswith("shared_")), F.lit(0))
    bad = (shared > 0) | (F.col("train_rows") == 0) | (F.col("validation_rows") == 0)
    return audit.withColumn("verdict", F.when(bad, F.raise_error(F.lit("cross-validation leakage or empty side"))).otherwise("ok"))


def partition_summary(rows, partition="partition", category="working_ion", group="group_id"):
    """Rows per (partition, ion) with the partition's row and group totals."""
    per = rows.groupBy(partition, category).agg(F.count(F.lit(1)).alias("n_rows"))
    total = rows.groupBy(partition).agg(F.count(F.lit(1)).alias("partition_rows"), F.countDistinct(group).alias("partition_groups"))
    return per.join(total, partition)


def transfer_overlap_counts(rows):
    """Shared and new rows per held-out ion and population."""
    long = rows.where(F.col("partition").isin(*[f"held_out_{i}" for i in TRANSFER_IONS])).select(
        F.col("working_ion").alias("ion"),
        F.inline(F.array(*[F.struct(F.lit(p).alias("population"), F.col(f"shares_group_with_{p}_development").alias("s"))
                           for p in ("mixed", "li")])))
    return long.groupBy("ion", "population").agg(F.count_if("s").alias("shared_rows"), F.count_if(~F.col("s")).alias("new_rows"))


def fold_invariants(rows, allowed_ions, uid="row_uid", group="group_id", ion="ion", fold="fold", role="role", y="y"):
    """Violation counters of a feature dataset; all zero for a valid one."""
    is_dev = F.col(role) == "development"
    base = rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(is_dev & ~F.coalesce(F.col(fold) >= 0, F.lit(False))).alias("development_without_fold"),
        F.count_if(~is_dev & ~F.coalesce(F.col(fold) == -1, F.lit(False))).alias("fold_outside_development"),
        F.count_if(~F.coalesce(F.col(ion).isin(*allowed_ions), F.lit(False))).alias("unexpected_ion"),
        F.count_if(F.col(y).isNull() | F.isnan(y) | (F.abs(y) == float("inf"))).alias("nonfinite_target"),
        F.count_if(~F.coalesce(F.col(uid) != "", F.lit(False))).alias("missing_uid"))
    spans = rows.where(is_dev).groupBy(group).agg((F.min(fold) != F.max(fold)).alias("bad")).agg(F.count_if("bad"))
    repeats = rows.groupBy(uid).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1))
    return base.withColumns({"groups_spanning_folds": spans.scalar(), "repeated_uids": repeats.scalar()})


ROLES = ("development", "holdout", *[f"held_out_{i}" for i in TRANSFER_IONS])


def split_guard(rows, folds, uid="row_uid", group="group_id", ion="ion", fold="fold", role="role", partition="partition",
                eligible="eligible", y="y", values="val"):
    """Rows (groups, ids) that break each rule of a split feature table: columns ``rule, n``, all zero for a sound one."""
    c = F.col
    known = F.coalesce(c(role).isin(*ROLES), F.lit(False))
    development, transfer = c(role) == "development", c(role).startswith("held_out_")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    in_core = c(ion).isin(*CORE_IONS)
    rules = {
        "missing_uid": ~F.coalesce(c(uid) != "", F.lit(False)),
        "missing_group": ~F.coalesce(c(group) != "", F.lit(False)),
        "unknown_role": ~known,
        "role_against_partition": known & ~c(role).eqNullSafe(c(partition)),
        "ineligible_row": ~F.coalesce(c(eligible), F.lit(False)),
        "ion_against_role": known & ~F.coalesce(F.when(transfer, c(role) == F.concat(F.lit("held_out_"), c(ion))).otherwise(in_core), F.lit(False)),
        "development_without_fold": development & ~F.coalesce(c(fold).between(0, folds - 1), F.lit(False)),
        "fold_outside_development": known & ~development & ~F.coalesce(c(fold) == -1, F.lit(False)),
        "nonfinite_target": ~F.coalesce(finite(c(y)), F.lit(False)),
        "nonfinite_features": ~F.coalesce(F.forall(values, finite), F.lit(False)),
    }
    per_row = rows.agg(*[F.count_if(test).alias(name) for name, test in rules.items()])
    grouped = rows.where(F.coalesce(c(group) != "", F.lit(False))).groupBy(group).agg(
        F.coalesce(F.min(F.when(development, c(fold))) != F.max(F.when(development, c(fold))), F.lit(False)).alias("spans"),
        (F.bool_or(F.coalesce(development, F.lit(False))) & F.bool_or(F.coalesce(c(role) == "holdout", F.lit(False)))).alias("held"))
    per_group = grouped.agg(F.count_if("spans").alias("group_spans_folds"), F.count_if("held").alias("group_in_development_and_holdout"))
    repeats = rows.where(F.coalesce(c(uid) != "", F.lit(False))).groupBy(uid).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_uid"))
    sides = rows.agg(F.coalesce(F.bool_or(development), F.lit(False)).alias("d")).select(F.when(F.col("d"), 0).otherwise(1).cast("bigint").alias("empty_development"))
    out = None
    for table in (per_row, per_group, repeats, sides):
        part = table.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in table.columns])))
        out = part if out is None else out.unionByName(part)
    return out


def assert_split(guard):
    """Turn a split's guard into an error that names the first broken rule."""
    return guard.withColumn("verdict", F.when(F.col("n") > 0, F.raise_error(F.concat(F.lit("split rule broken: "), "rule"))).otherwise("ok"))
