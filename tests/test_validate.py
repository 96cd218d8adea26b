from pyspark.sql import functions as F

from ionforge.constants import SplitSettings
from ionforge.operators import components, splits, validate
from ionforge.plans.flows import GROUP_KINDS
from ionforge.session import stored


def example(n, ion="Li", **change):
    host = f"Fe{n}O{2 * n + 1}"
    row = dict(record_key=f"rec{n}{ion}", battery_id="", row_type="adjacent", interval_index="0", working_ion=ion, framework_formula=host,
               formula_charge=host, formula_discharge=ion + host, id_charge=f"mp-host-{n}", id_discharge=f"mp-{ion}-{n}", fracA_charge="0",
               fracA_discharge=repr(1 / (3 * n + 2)), average_voltage_V="3.4", crystal_system_charge="Orthorhombic", crystal_system_discharge="Orthorhombic",
               spacegroup_number_charge="62", spacegroup_number_discharge="62", issues="", warnings="")
    return {**row, **change}


def run(spark, rows):
    df = spark.createDataFrame([{**r, "source_row": i + 2} for i, r in enumerate(rows)])
    return {r.source_row - 2: r for r in validate.validate(df).collect()}


def test_group_rules(spark):
    a = example(1)
    out = run(spark, [a, a, example(2), example(2, average_voltage_V="3.9", interval_index="1"), example(3), example(3, interval_index="1"),
                      example(4), example(4, average_voltage_V="2"), example(5, id_charge="mp-host-6"), example(6), example(7)])
    flags = {i: r.step4_issues for i, r in out.items()}
    assert flags[0] == [] and flags[1] == ["exact_duplicate_input_row"]
    assert flags[2] == flags[3] == ["conflicting_reaction_labels"]
    assert flags[4] == flags[5] == ["repeated_reaction_requires_provenance_review"]
    assert flags[6] == flags[7] == ["conflicting_reaction_labels", "conflicting_source_interval_identity"]
    assert flags[8] == flags[9] == ["conflicting_endpoint_metadata"]
    assert flags[10] == [] and out[10].review_flags == ["battery_id_absent_using_record_key"]


def test_composition_verdict_ignores_symmetry(spark):
    out = run(spark, [example(1, spacegroup_number_charge="0"), example(2, crystal_system_charge=""), example(3, spacegroup_number_charge="225")])
    assert all(r.composition_checks_passed and not r.symmetry_checks_passed for r in out.values())
    assert [out[i].step4_issues for i in range(3)] == [["invalid_spacegroup_charge"], ["missing_symmetry_charge"], ["spacegroup_crystal_system_mismatch_charge"]]


def test_split_is_label_and_order_invariant_and_leak_free(spark):
    rows = [example(n, ion) for n in range(1, 31) for ion in ("Li", "Mg")] + [example(n, ion) for n in range(25, 34) for ion in ("Na", "K")]
    settings = SplitSettings(cv_folds=3)

    def assignment(records, parts):
        df = spark.createDataFrame([{**r, "source_row": i} for i, r in enumerate(records)]).repartition(parts)
        grouped = stored(components.connected_groups(stored(validate.validate(df), "v"), "row_uid", GROUP_KINDS), "g")
        split = stored(splits.assign_partitions(grouped, settings), "s")
        return split, {(r.row_uid, r.partition, r.mixed_cv_fold, r.li_cv_fold) for r in split.collect()}

    split, one = assignment(rows, 1)
    changed = [{**r, "average_voltage_V": "1.25"} for r in reversed(rows)]
    _, two = assignment(changed, 6)
    assert one == two
    audit = splits.cv_leakage_audit(split, "mixed_cv_fold", "mixed", settings)
    assert splits.assert_no_leakage(audit).count() == 3
    assert split.where("partition IN ('development', 'holdout')").where(F.col("working_ion").isin("Na", "K")).count() == 0
