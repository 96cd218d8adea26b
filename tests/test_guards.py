import pytest
from pyspark.sql import functions as F

from ionforge.operators import preprocess, splits
from ionforge.sources import records, tables

SCHEMA = "row_uid string, group_id string, ion string, role string, partition string, fold int, eligible boolean, y double, val array<double>"
SOUND = [
    ("u1", "g1", "Li", "development", "development", 0, True, 1.0, [1.0]), ("u2", "g2", "Mg", "development", "development", 1, True, -2.0, [0.5, 2.0]),
    ("u3", "g3", "Li", "holdout", "holdout", -1, True, 0.0, [1.0]), ("u4", "g1", "Na", "held_out_Na", "held_out_Na", -1, True, 3.0, [1.0]),
]
FAULTS = {
    "missing_uid": (0, {"row_uid": ""}), "missing_group": (2, {"group_id": None}), "unknown_role": (2, {"role": "archive"}),
    "role_against_partition": (2, {"partition": "development"}), "ineligible_row": (1, {"eligible": None}),
    "ion_against_role": (2, {"ion": "K"}), "development_without_fold": (1, {"fold": None}), "fold_outside_development": (3, {"fold": 0}),
    "nonfinite_target": (0, {"y": float("inf")}), "nonfinite_features": (0, {"val": [float("nan")]}),
    "group_spans_folds": (1, {"group_id": "g1"}), "group_in_development_and_holdout": (2, {"group_id": "g2"}), "repeated_uid": (1, {"row_uid": "u1"}),
}


def guard(spark, rows):
    return splits.split_guard(spark.createDataFrame(rows, SCHEMA), 2)


def test_a_sound_split_passes(spark):
    assert {r.verdict for r in splits.assert_split(guard(spark, SOUND)).collect()} == {"ok"}


@pytest.mark.parametrize("rule", FAULTS)
def test_one_fault_breaks_one_rule(spark, rule):
    at, change = FAULTS[rule]
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    rows = [tuple({**dict(zip(names, r)), **(change if i == at else {})}.values()) for i, r in enumerate(SOUND)]
    found = guard(spark, rows)
    assert {r.rule for r in found.collect() if r.n} == {rule}
    with pytest.raises(Exception, match=f"split rule broken: {rule}"):
        splits.assert_split(found).collect()


def test_an_empty_development_is_a_fault(spark):
    assert {r.rule for r in guard(spark, SOUND[2:]).collect() if r.n} == {"empty_development"}


def test_scopes_are_refused_by_name(spark):
    rows = spark.createDataFrame([(f"u{i}", i % 3) for i in range(9)], "row_uid string, fold int")
    own = preprocess.scope_claims(rows, 3, "mixed", "schema")
    assert {r.status for r in preprocess.assert_scopes(preprocess.scope_audit(own, own)).collect()} == {"ok"}
    for change, status in ((own.where("scope <> 1"), "unclaimed"), (own.withColumn("feature_digest", F.lit("x")), "other_features"),
                           (preprocess.scope_claims(rows.where("row_uid <> 'u0'"), 3, "mixed", "schema"), "other_rows"),
                           (own.withColumn("population", F.lit("li")), "unknown_scope")):
        with pytest.raises(Exception, match="scope refused"):
            preprocess.assert_scopes(preprocess.scope_audit(change, own)).collect()
        assert status in {r.status for r in preprocess.scope_audit(change, own).collect()}


def test_a_rerun_replaces_the_tables_of_its_model_only(spark, tmp_path):
    rows = spark.createDataFrame([("development", "u1", 1), ("holdout", "u2", 2)], "partition string, row_uid string, source_row int")
    for model in ("a", "b", "a"):
        tables.write_split_tables(rows if model == "b" else rows.where("source_row = 1"), str(tmp_path), model)
    assert sorted((r.model, r.source_row) for r in spark.read.parquet(str(tmp_path)).collect()) == [("a", 1), ("b", 1), ("b", 2)]


def test_a_torn_line_is_numbered_across_splits(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text("".join('{"a": %d}\n%s' % (i, "\n" * (i % 7 == 0)) for i in range(500)) + '{"a": 5', "utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        good, issues = records.read_jsonl_torn_tail(spark, str(path), "a int")
        assert good.count() == 500 and [(r.kind, r.line) for r in issues.collect()] == [("discarded_unfinished_line", 500 + 72 + 1)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_metadata_is_accepted_once_or_named(spark):
    from ionforge.operators.dedup import resolve_metadata
    rows = [("a", "x")] * 5 + [("b", "x"), ("b", "y"), ("c", None), ("d", "x"), (None, "x")]
    records_, wanted = spark.createDataFrame(rows, "material_id string, status string"), spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("e",), (None,)], "material_id string")
    accepted, issues = resolve_metadata(records_, wanted)
    assert sorted(map(tuple, accepted.collect())) == [("a", "x"), ("c", None)] and accepted.columns == records_.columns
    assert sorted((r.kind, str(r.material_id)) for r in issues.collect()) == [
        ("conflicting_metadata", "b"), ("rejected_metadata_id", "None"), ("rejected_metadata_id", "d"), ("unresolved_metadata", "b"), ("unresolved_metadata", "e")]
