"""Composition, symmetry and label validation of all-text interval rows."""

from pyspark.sql import functions as F

from ionforge.constants import CORE_IONS, SIDES, TRANSFER_IONS, SplitSettings
from ionforge.functions.composition import host_key, parse_formulas, reduce_composition, with_algebra
from ionforge.functions.keys import fingerprint, row_uid
from ionforge.functions.values import crystal_system, finite_number, has_text, is_digits, stripped
from ionforge.operators.dedup import flag_exact_duplicate_rows, flag_identity_conflict
from ionforge.operators.skew import attach, attach_stored
from ionforge.rules import canonical_flags, flags, join_flags
from ionforge.session import stored

# The columns that an interval row must have.
REQUIRED = (
    "record_key", "row_type", "interval_index", "working_ion", "framework_formula",
    "formula_charge", "formula_discharge", "id_charge", "id_discharge", "fracA_charge",
    "fracA_discharge", "average_voltage_V", "crystal_system_charge", "crystal_system_discharge",
    "spacegroup_number_charge", "spacegroup_number_discharge",
)


def require_columns(rows, names=REQUIRED):
    missing = sorted(set(names) - set(rows.columns))
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    return rows


def row_identity(rows, content):
    """Add ``row_uid`` and the hash of the whole input row."""
    return rows.withColumns({"row_uid": row_uid(F.col("record_key"), F.col("interval_index")),
                             "input_row_hash": fingerprint(rows, content)})


def with_reaction_algebra(rows, ion="working_ion"):
    """Add per endpoint and framework the reduced host with its loading and fraction, and the endpoints' reduced keys, in one pass of the rows."""
    rows = with_algebra(rows, ion, __host_charge="formula_charge", __host_discharge="formula_discharge", __ff="framework_formula")
    return rows.withColumns({f"reduced_{s}": F.col(f"__host_{s}")["key"] for s in SIDES} | {"__framework": F.col("__ff")["key"]}).drop("__ff")


def reaction_consistency(rows, tolerance=1e-6):
    """Per-row verdicts of the two endpoints against each other and the framework."""
    hc, hd = F.col("__host_charge"), F.col("__host_discharge")
    both = hc["host"].isNotNull() & hd["host"].isNotNull()
    same = F.coalesce(hc["host"] == hd["host"], F.lit(False))
    on_framework = F.coalesce(hc["host"] == F.col("__framework"), F.lit(False))
    delta = hd["loading"] - hc["loading"]
    added = {}
    rows = rows.withColumns({f"__supplied_{s}": finite_number(F.col(f"fracA_{s}")) for s in SIDES})
    for side in SIDES:
        h, supplied = F.col(f"__host_{side}"), F.col(f"__supplied_{side}")
        added[f"computed_fracA_{side}"] = h["fraction"]
        added[f"ion_per_reduced_host_{side}"] = h["loading"]
        added[f"fraction_error_{side}"] = F.abs(h["fraction"] - supplied)
    rows = rows.withColumns({
        **added, "delta_ion_per_reduced_host": delta,
        "host_changed": both & ~same, "framework_mismatch": both & same & ~on_framework,
        "non_increasing_loading": F.coalesce(delta <= 0, F.lit(False)),
        "canonical_host": F.when(both & same & on_framework, hc["host"]).otherwise(""),
    })
    mismatch = {f"fraction_mismatch_{s}": F.coalesce(F.col(f"fraction_error_{s}") > tolerance, F.lit(False)) for s in SIDES}
    return rows.withColumns(mismatch).drop(*[f"__supplied_{s}" for s in SIDES])


def validation_rules(rows, settings=SplitSettings()):
    """All per-row rules; flags stay arrays (``problems``, ``review_flags``).

    The composition verdict is taken before the symmetry rules are added.
    """
    rows = reaction_consistency(with_reaction_algebra(require_columns(rows)), settings.fraction_tolerance)
    # numbers that several rules read are columns, so each is parsed once
    rows = rows.withColumns({"__voltage": finite_number(F.col("average_voltage_V")), **{f"__given_{s}": finite_number(F.col(f"fracA_{s}")) for s in SIDES},
                             **{f"__number_{s}": F.when(is_digits(F.col(f"spacegroup_number_{s}")), F.col(f"spacegroup_number_{s}").try_cast("int")) for s in SIDES},
                             **{f"__system_{s}": F.lower(stripped(F.col(f"crystal_system_{s}"))) for s in SIDES}})
    optional = lambda name: F.col(name) if name in rows.columns else F.lit("")
    composition = [
        ("unsupported_working_ion", ~F.coalesce(F.col("working_ion").isin(*CORE_IONS, *TRANSFER_IONS), F.lit(False))),
        ("row_is_not_an_adjacent_interval", ~F.coalesce(F.col("row_type") == "adjacent", F.lit(False))),
        ("missing_source_record_key", ~has_text(F.col("record_key"))),
        ("invalid_interval_index", ~is_digits(F.col("interval_index"))),
        ("unresolved_step3_issue", has_text(optional("issues"))),
    ]
    for s in SIDES:
        supplied = F.col(f"__given_{s}")
        composition += [
            (f"missing_endpoint_id_{s}", ~has_text(F.col(f"id_{s}"))),
            (f"invalid_fraction_{s}", ~F.coalesce((supplied >= 0) & (supplied < 1), F.lit(False))),
            (f"unsupported_or_invalid_formula_{s}", F.col(f"__host_{s}")["host"].isNull()),
            (f"formula_fraction_mismatch_{s}", F.col(f"fraction_mismatch_{s}")),
        ]
    composition += [
        ("unsupported_or_invalid_framework_formula", F.col("__framework").isNull()),
        ("host_composition_changed", F.col("host_changed")),
        ("framework_composition_mismatch", F.col("framework_mismatch")),
        ("non_increasing_ion_loading", F.col("non_increasing_loading")),
    ]
    symmetry = []
    for s in SIDES:
        text, system, number = F.col(f"spacegroup_number_{s}"), F.col(f"__system_{s}"), F.col(f"__number_{s}")
        blank = ~F.coalesce((text != "") & (system != ""), F.lit(False))
        in_range = F.coalesce(number.between(1, 230), F.lit(False))
        symmetry += [
            (f"missing_symmetry_{s}", blank),
            (f"invalid_spacegroup_{s}", ~blank & ~in_range),
            (f"spacegroup_crystal_system_mismatch_{s}",
             ~blank & in_range & ~F.coalesce(crystal_system(number) == system, F.lit(False))),
        ]
    voltage = F.col("__voltage")
    priority = F.coalesce((voltage < settings.review_low) | (voltage > settings.review_high), F.lit(False))
    review = [
        ("battery_id_absent_using_record_key", ~has_text(optional("battery_id"))),
        ("priority_voltage_review", priority),
        ("negative_voltage", F.coalesce(voltage < 0, F.lit(False))),
    ]
    carried = F.filter(F.split(F.coalesce(optional("warnings"), F.lit("")), ";"),
                       lambda w: w.startswith("source:") | w.startswith("deprecated_material_"))
    rows = rows.withColumns({"__composition": flags(composition), "__symmetry": flags(symmetry)})
    return rows.withColumns({
        "problems": join_flags(F.col("__composition"), F.col("__symmetry"), flags([("invalid_voltage_label", voltage.isNull())])),
        "composition_checks_passed": F.size("__composition") == 0,
        "symmetry_checks_passed": F.size("__symmetry") == 0,
        "review_flags": canonical_flags(flags(review), carried),
        "priority_voltage_review": priority, "label": voltage,
    }).drop("__composition", "__symmetry", "__framework", "__voltage", *[f"__{n}_{s}" for n in ("host", "given", "number", "system") for s in SIDES])


def _reduced_endpoint_keys(rows):
    if {"reduced_charge", "reduced_discharge"} <= set(rows.columns):
        return rows
    rows = parse_formulas(rows, __fc="formula_charge", __fd="formula_discharge")
    rows = reduce_composition(rows, __rc="__fc.comp", __rd="__fd.comp")
    return rows.withColumns({f"reduced_{s}": host_key(f"__r{s[0]}") for s in SIDES}).drop("__fc", "__fd", "__rc", "__rd")


def conflicting_endpoint_ids(rows):
    """Endpoint ids described by several reduced formulas or several symmetries."""
    keyed = _reduced_endpoint_keys(rows)
    stacked = keyed.select(F.inline(F.array(*[F.struct(
        F.col(f"id_{s}").alias("id"), F.col(f"reduced_{s}").alias("formula"),
        F.when((F.col(f"spacegroup_number_{s}") != "") & (F.col(f"crystal_system_{s}") != ""),
               F.concat_ws("\t", f"spacegroup_number_{s}", F.lower(f"crystal_system_{s}"))).alias("symmetry")) for s in SIDES])))
    return (stacked.where(F.col("id") != "").groupBy("id")
            .agg(F.count(F.lit(1)).alias("n"),
                 (F.coalesce(F.min("formula") != F.max("formula"), F.lit(False))
                  | F.coalesce(F.min("symmetry") != F.max("symmetry"), F.lit(False))).alias("bad"))
            .where("bad"))


def endpoint_conflicts(rows, spread, out="endpoint_conflict"):
    """Flag every row that touches a conflicting endpoint id on either side."""
    bad = stored(conflicting_endpoint_ids(rows), "conflicts")
    for s in SIDES:
        side = bad.select(F.col("id").alias(f"id_{s}"), F.col("bad").alias(f"__bad_{s}"), "n")
        rows = attach_stored(rows, side, [f"id_{s}"], [f"__bad_{s}"], spread)
    hit = F.coalesce("__bad_charge", "__bad_discharge", F.lit(False))
    return rows.withColumn(out, hit).drop("__bad_charge", "__bad_discharge")


def repeated_reaction_review(rows, label, content_hash, spread, tolerance=1e-8, out="reaction_flag", base=None):
    """Repeated reactions need review; differing or invalid labels conflict.

    Exact copies (same content hash) count once and, being excluded already,
    are not flagged: only the rows with ``exact_duplicate`` false are looked up.
    """
    keys = ["__ion", "__ic", "__id"]
    usable = (F.col("id_charge") != "") & (F.col("id_discharge") != "")
    key_values = {"__ion": F.coalesce("working_ion", F.lit("")), "__ic": F.col("id_charge"), "__id": F.col("id_discharge")}
    named = lambda df, ok: df.withColumns({k: F.when(ok, v) for k, v in key_values.items()})
    source = rows if base is None else base
    copies = (named(source, usable).where(F.col("__ion").isNotNull()).groupBy(*keys, content_hash)
              .agg(F.min(label).alias("__label")))
    stats = (copies.groupBy(*keys)
             .agg(F.count(F.lit(1)).alias("n"),
                  (F.bool_or(F.col("__label").isNull())
                   | F.coalesce(F.max("__label") - F.min("__label") > tolerance, F.lit(False))).alias("__conflict"))
             .where("n > 1"))
    out_rows = attach(named(rows, usable & ~F.col("exact_duplicate")), stats, keys, ["__conflict"], spread)
    code = (F.when(F.col("__conflict"), "conflicting_reaction_labels")
            .when(~F.col("__conflict"), "repeated_reaction_requires_provenance_review"))
    return out_rows.withColumn(out, code).drop(*keys, "__conflict")


def eligibility_split(rows, *extra_flags):
    """Final sorted unique issue list and the eligibility verdict."""
    rows = rows.withColumn("step4_issues", canonical_flags(F.col("problems"), *extra_flags))
    return rows.withColumn("eligible_for_baseline", F.size("step4_issues") == 0)


def validate(rows, settings=SplitSettings(), position="source_row"):
    """Every validation rule over all-text rows: per row, per endpoint, per copy, per reaction.

    The per-row result is stored once; the four group checks then aggregate a
    few pruned columns of it and are looked up skew-safely.
    """
    content = [c for c in rows.columns if c != position]
    base = stored(validation_rules(row_identity(rows, content), settings), "validated")
    out = endpoint_conflicts(base, [position])
    out = flag_exact_duplicate_rows(out, "input_row_hash", position, base=base)
    out = flag_identity_conflict(out, "row_uid", "input_row_hash", [position], base=base)
    out = repeated_reaction_review(out, "label", "input_row_hash", [position], settings.label_tolerance, base=base)
    group_flags = flags([
        ("conflicting_endpoint_metadata", F.col("endpoint_conflict")),
        ("exact_duplicate_input_row", F.col("exact_duplicate")),
        ("conflicting_source_interval_identity", F.col("identity_conflict")),
        (F.col("reaction_flag"), F.col("reaction_flag").isNotNull()),
    ])
    return eligibility_split(out, group_flags)


def priority_review_list(rows, label="label", low=-3.0, high=10.0):
    return rows.where((F.col(label) < low) | (F.col(label) > high)).orderBy(label)
