"""Electrode documents to audited interval rows."""

from pyspark.sql import functions as F

from ionforge.constants import CORE_IONS, INTERVAL_FIELDS, SIDES
from ionforge.functions.keys import fingerprint
from ionforge.functions.values import finite_or_null, has_text, is_finite, normalize_symbol
from ionforge.operators.ranking import exact_median
from ionforge.operators.skew import attach, lookup
from ionforge.rules import any_of, flag_text, flags

PAIR_FIELDS = ("formula_charge", "formula_discharge", "id_charge", "id_discharge",
               "fracA_charge", "fracA_discharge", "average_voltage")
PAIR_TYPE = ("struct<formula_charge:string,formula_discharge:string,id_charge:string,id_discharge:string,"
             "fracA_charge:double,fracA_discharge:double,average_voltage:double>")
DOCUMENT_SCHEMA = (
    "battery_id string, working_ion string, framework_formula string, num_steps int, last_updated string, "
    "warnings array<string>, formula_charge string, formula_discharge string, id_charge string, "
    "id_discharge string, fracA_charge double, fracA_discharge double, average_voltage double, "
    f"adj_pairs array<{PAIR_TYPE}>"
)
MATERIAL_SCHEMA = ("material_id string, formula_pretty string, "
                   "symmetry struct<crystal_system:string,number:int>, deprecated boolean")
PARENT_FIELDS = ("battery_id", "working_ion", "framework_formula", "num_steps", "last_updated", "warnings")


def with_record_key(documents, columns=None):
    return documents.withColumn("record_key", fingerprint(documents, columns or documents.columns))


def collapse_exact_documents(documents, key, position):
    """Keep the first of identical fingerprints; add the number of copies it stands for."""
    first = documents.groupBy(key).agg(F.min(position).alias(position), F.count(F.lit(1)).alias("copies"))
    return documents.join(first, [key, position])


def _row(row_type, index, source):
    return [F.col("record_key"), F.lit(row_type).alias("row_type"), index.alias("interval_index"),
            *[F.col(c) for c in PARENT_FIELDS], *[source(f).alias(f) for f in PAIR_FIELDS]]


def overall_rows(documents):
    """One row per document from its own endpoints; emitted with or without pairs."""
    return documents.select(*_row("overall", F.lit(None).cast("int"), F.col))


def explode_intervals(documents):
    """One row per pair with its 0-based index; endpoints come from the pair only."""
    pairs = documents.select("record_key", *PARENT_FIELDS, F.posexplode("adj_pairs").alias("pos", "pair"))
    return pairs.where(F.col("pair").isNotNull()).select(*_row("adjacent", F.col("pos"), lambda f: F.col(f"pair.{f}")))


def pair_counts(documents):
    """Documents without pairs and null pair entries."""
    size = F.coalesce(F.size("adj_pairs"), F.lit(0))
    empty = F.col("adj_pairs").isNull() | (size == 0)
    return documents.agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(empty).alias("documents_without_pairs"),
        F.coalesce(F.sum(F.when(~empty, F.size(F.filter("adj_pairs", lambda p: p.isNull())))), F.lit(0))
        .cast("bigint").alias("malformed_pairs"))


def requested_endpoint_ids(documents):
    """Distinct non-empty endpoint ids of documents and their pairs."""
    pair_ids = [F.transform(F.coalesce("adj_pairs", F.array().cast(f"array<{PAIR_TYPE}>")), lambda p: p[f"id_{s}"])
                for s in SIDES]
    ids = F.concat(F.array(*[F.col(f"id_{s}") for s in SIDES]), *pair_ids)
    return documents.select(F.explode(ids).alias("material_id")).where(F.col("material_id") != "").distinct()


def attach_endpoint_metadata(rows, materials, spread=("record_key", "interval_index")):
    """Symmetry metadata of both endpoints; unknown ids keep nulls."""
    base = rows
    for side in SIDES:
        dim = materials.where(has_text(F.col("material_id"))).select(
            F.col("material_id").alias(f"id_{side}"), F.lit(True).alias(f"found_{side}"),
            F.col("symmetry.crystal_system").alias(f"crystal_system_{side}"),
            F.col("symmetry.number").alias(f"spacegroup_number_{side}"),
            F.coalesce("deprecated", F.lit(False)).alias(f"deprecated_{side}"))
        rows = lookup(rows, dim, [f"id_{side}"],
                      [f"found_{side}", f"crystal_system_{side}", f"spacegroup_number_{side}", f"deprecated_{side}"],
                      spread, counted=base)
    return rows


def inspection_rules(rows):
    """Issue and warning codes of joined interval rows, plus the two pass verdicts."""
    ion = normalize_symbol(F.col("working_ion"))
    rows = rows.withColumns({
        "working_ion": ion, "paper_training_ion": F.coalesce(ion.isin(*CORE_IONS), F.lit(False)),
        **{f"crystal_system_{s}": F.when(has_text(F.col(f"crystal_system_{s}")), F.col(f"crystal_system_{s}")) for s in SIDES},
        **{f"spacegroup_number_{s}": F.when(F.col(f"spacegroup_number_{s}").between(1, 230), F.col(f"spacegroup_number_{s}"))
           for s in SIDES},
        "average_voltage_V": finite_or_null(F.col("average_voltage")),
    })
    issues = [("missing_or_unsupported_working_ion", F.col("working_ion").isNull())]
    warnings = [("missing_battery_id_use_record_key_for_provenance", ~has_text(F.col("battery_id")))]
    for s in SIDES:
        frac, sid, found = F.col(f"fracA_{s}"), F.col(f"id_{s}"), F.coalesce(F.col(f"found_{s}"), F.lit(False))
        issues += [
            (f"missing_formula_{s}", ~has_text(F.col(f"formula_{s}"))),
            (f"invalid_fracA_{s}", ~(is_finite(frac) & F.coalesce((frac >= 0) & (frac < 1), F.lit(False)))),
        ]
        warnings += [
            (f"missing_id_{s}", ~has_text(sid)),
            (f"missing_material_metadata_{s}", has_text(sid) & ~found),
            (f"missing_crystal_system_{s}", F.col(f"crystal_system_{s}").isNull()),
            (f"missing_spacegroup_number_{s}", F.col(f"spacegroup_number_{s}").isNull()),
            (f"deprecated_material_{s}", F.coalesce(F.col(f"deprecated_{s}"), F.lit(False))),
        ]
    lo, hi = F.col("fracA_charge"), F.col("fracA_discharge")
    issues += [
        ("non_increasing_working_ion_fraction", is_finite(lo) & is_finite(hi) & (hi <= lo)),
        ("missing_or_nonfinite_voltage", F.col("average_voltage_V").isNull()),
    ]
    source = F.transform(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: F.concat(F.lit("source:"), w))
    rows = rows.withColumns({"issues": flags(issues), "warnings": F.concat(flags(warnings), source)})
    complete = ~any_of(*[F.col(f"{f}_{s}").isNull() for f in ("crystal_system", "spacegroup_number") for s in SIDES],
                       *[~has_text(F.col(f"id_{s}")) for s in SIDES])
    return rows.withColumns({
        "basic_checks_passed": F.size("issues") == 0,
        "complete_basic_inputs": (F.size("issues") == 0) & complete,
    })


def repeated_interval_identity(rows, tolerance=1e-6, spread=("record_key", "interval_index")):
    """Flag repeated (ion, charge id, discharge id); conflicting labels also fail the row."""
    keys = ["__ion", "__ic", "__id"]
    usable = has_text(F.col("id_charge")) & has_text(F.col("id_discharge"))
    keyed = rows.withColumns({
        "__ion": F.when(usable, F.coalesce("working_ion", F.lit(""))),
        "__ic": F.when(usable, F.col("id_charge")), "__id": F.when(usable, F.col("id_discharge"))})
    label = F.col("average_voltage_V")
    stats = (keyed.where(F.col("__ion").isNotNull()).groupBy(*keys)
             .agg(F.count(F.lit(1)).alias("n"), (F.max(label) - F.min(label)).alias("__range"))
             .where(F.col("n") > 1)
             .withColumn("__conflict", F.coalesce(F.col("__range") > tolerance, F.lit(False))))
    out = attach(keyed, stats, keys, ["__conflict"], spread)
    conflict = F.coalesce("__conflict", F.lit(False))
    return out.withColumns({
        "warnings": F.concat("warnings", flags([("repeated_interval_identity_review_required", F.col("__conflict").isNotNull())])),
        "issues": F.concat("issues", flags([("conflicting_interval_labels", conflict)])),
        "basic_checks_passed": F.col("basic_checks_passed") & ~conflict,
        "complete_basic_inputs": F.col("complete_basic_inputs") & ~conflict,
    }).drop(*keys, "__conflict")


def interval_table(rows):
    """Fixed export order with flag arrays flattened to text."""
    return rows.withColumns({"issues": flag_text("issues"), "warnings": flag_text("warnings")}).select(*INTERVAL_FIELDS)


def flag_counts(rows, column):
    return rows.select(F.explode(column).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def label_profile(rows, groups, label="average_voltage_V", passed="basic_checks_passed", complete="complete_basic_inputs"):
    """Rows, pass counts, label quality and exact label statistics per group."""
    v = finite_or_null(F.col(label))
    base = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(passed)).alias("passed"),
        F.count_if(F.col(complete)).alias("complete"), F.count_if(v.isNull()).alias("missing"),
        F.count_if(v < 0).alias("negative"), F.count_if(v == 0).alias("zero"),
        F.min(v).alias("min_label"), F.max(v).alias("max_label"), F.avg(v).alias("mean_label"))
    medians = exact_median(rows.withColumn("__label", v), groups, "__label", "median_label")
    return base.join(medians, groups, "left")


def dataset_report(rows, partition="partition", category="working_ion", group="group_id"):
    """Row and distinct-group counts at three grains in one pass of grouping sets."""
    sets = [[F.col(partition)], [F.col(partition), F.col(category)], []]
    return (rows.groupingSets(sets, partition, category)
            .agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(group).alias("n_groups"),
                 F.grouping_id().cast("bigint").alias("grain")))


def run_report(documents, rows, split, audits, fingerprint="record_key", partition="partition", group="group_id"):
    """One table of a whole run: ``section, item, n``.

    Documents (raw, unique, without pairs, missing pairs), interval rows (all,
    passed, complete), every issue and warning code, rows and groups of each
    partition, groups and the largest one, and what the leak audits found.
    Every part is a small aggregate with map-side combine.
    """
    pairs = F.coalesce("adj_pairs", F.array().cast(documents.schema["adj_pairs"].dataType))
    named = lambda section, table: table.select(F.lit(section).alias("section"), F.inline(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("bigint").alias("n")) for c in table.columns])))
    flags_of = lambda column: flag_counts(rows, column).select(F.lit(column).alias("section"), F.col("flag").alias("item"), "n")
    per_group = split.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    shared = [c for c in audits.columns if c.startswith("shared_")]
    by_partition = split.groupBy(partition).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(group).alias("groups"))
    by_partition = by_partition.select(F.explode(F.array(*[F.struct(F.lit(f"partition_{c}").alias("section"), F.col(partition).alias("item"), F.col(c).alias("n")) for c in ("rows", "groups")])).alias("x")).select("x.*")
    parts = [
        named("documents", documents.agg(
            F.count(F.lit(1)).alias("raw"), F.countDistinct(fingerprint).alias("unique"), F.count_if(F.size(pairs) == 0).alias("without_pairs"),
            F.sum(F.size(F.filter(pairs, lambda p: p.isNull()))).alias("missing_pairs"))),
        named("intervals", rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if("basic_checks_passed").alias("passed"), F.count_if("complete_basic_inputs").alias("complete"))),
        flags_of("issues"), flags_of("warnings"), by_partition,
        named("groups", per_group.agg(F.count(F.lit(1)).alias("number"), F.max("size").alias("largest"))),
        named("checks", audits.agg(F.count(F.lit(1)).alias("fold_pairs"), F.sum(sum((F.col(c) for c in shared), F.lit(0))).alias("shared_tokens"),
                                   F.count_if((F.col("train_rows") == 0) | (F.col("validation_rows") == 0)).alias("empty_sides"))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def inspect_documents(documents, materials, position):
    """Full ingest: collapse copies, explode, join metadata, apply rules and identity checks."""
    keyed = collapse_exact_documents(
        with_record_key(documents, [c for c in documents.columns if c != position]), "record_key", position)
    overall = inspection_rules(attach_endpoint_metadata(overall_rows(keyed), materials))
    adjacent = repeated_interval_identity(inspection_rules(attach_endpoint_metadata(explode_intervals(keyed), materials)))
    return overall, adjacent
