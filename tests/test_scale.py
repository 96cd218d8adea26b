"""Steps that must not move whole rows, or grow faster than their input."""

from ionforge.functions.composition import parse
from ionforge.operators import validate


def test_formula_algebra_moves_no_rows(spark):
    rows = spark.createDataFrame(
        [("Li", "FePO4", "LiFePO4", "FePO4")], "working_ion string, formula_charge string, formula_discharge string, framework_formula string")
    plan = validate.with_reaction_algebra(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_counts_and_brackets_of_odd_formulas():
    assert parse("H1000000") == ((("H", 1_000_000),), None) and parse("H10000000")[1] == parse("H1000001")[1] == parse("Fe0")[1] == "invalid_count"
    assert parse("[(OH])2")[1] == parse("(OH")[1] == parse("OH)")[1] == "unbalanced_group" and parse("(2H)")[1] == "unsupported_notation"
    assert parse("(())0")[1] == "empty_group" and parse("Fe2Fe(Fe[O2]3)2")[0] == (("Fe", 5), ("O", 12))
