import pytest
from pyspark.sql import functions as F

from ionforge.functions import composition as comp

ACCEPTED = {
    "K4[Fe(CN)6]": "C:6|Fe:1|K:4|N:6", "CH3COOH": "C:2|H:4|O:2", "Ca3(PO4)2": "Ca:3|O:8|P:2", "Fe6Mg9": "Fe:6|Mg:9",
    "H1000000": "H:1000000", "(" * 12 + "H" + ")" * 12: "H:1", "Fe[P(O2)2]3": "Fe:1|O:12|P:3",
}
REJECTED = {
    "": "empty_or_oversized", None: "empty_or_oversized", "H" * 1025: "empty_or_oversized", "Xx2O": "unknown_element",
    "Li0O": "invalid_count", "H01": "invalid_count", "H1000001": "invalid_count", "Li0.5FePO4": "unsupported_notation",
    "CuSO4·5H2O": "unsupported_notation", "2H2O": "unsupported_notation", "(2H)": "unsupported_notation",
    "SO4-2": "unsupported_notation", "Fe 2 O3": "unsupported_notation", "Fe(OH": "unbalanced_group", "Fe)2": "unbalanced_group",
    "Fe[OH)2": "unbalanced_group", "[(OH])2": "unbalanced_group", "Fe()2": "empty_group",
    "(" * 13 + "H" + ")" * 13: "nesting_limit", "(H1000000)1000000": "atom_limit",
    "(((H1000000)1000000)1000000)1000000": "atom_limit",
}


def test_notation(spark):
    df = spark.createDataFrame([(f,) for f in [*ACCEPTED, *REJECTED]], "f string")
    out = comp.parse_formulas(df, p="f").select("f", comp.host_key("p.comp").alias("text"), "p.error")
    for row in out.collect():
        if row.f in ACCEPTED:
            assert (row.text, row.error) == (ACCEPTED[row.f], None)
        else:
            assert (row.text, row.error) == (None, REJECTED[row.f]), row.f


def test_host_is_invariant_to_formula_multiples(spark):
    df = spark.createDataFrame([("LiFePO4", "Li"), ("Li2Fe2(PO4)2", "Li"), ("Li", "Li"), ("C6", "Li"), ("LiC6", "Li")], "f string, ion string")
    out = comp.with_host(comp.parse_formulas(df, p="f"), "ion", h="p.comp")
    rows = {r.f: r for r in out.select("f", comp.host_key("h.host").alias("key"), "h.loading", "h.fraction").collect()}
    one, two = rows["LiFePO4"], rows["Li2Fe2(PO4)2"]
    assert (one.key, one.loading, one.fraction) == (two.key, two.loading, two.fraction) == ("Fe:1|O:4|P:1", 1.0, 1 / 7)
    assert rows["Li"].key is None
    assert rows["C6"].loading == 0 and rows["LiC6"].loading == pytest.approx(1 / 6)


def test_filter_on_error_does_not_repeat_the_parser(spark):
    df = spark.createDataFrame([("Fe(OH",)], "f string")
    parsed = comp.parse_formulas(df, p="f").where(F.col("p.error").isNotNull())
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") < 20
    assert parsed.count() == 1


def test_distinct_formulas_are_parsed_once_with_the_same_result(spark):
    from ionforge.functions.composition import parse_formulas
    from ionforge.operators.formulas import formula_table, parse_distinct
    odd = [None, "", "Fe(OH", "Fe(OH]2", "K4[Fe(CN)6]", "CH3COOH", "Xx2", "Fe0", "LiFePO4", "A" * 2000, "((((((((((((((Li))))))))))))))", "Fe1000000", "Fe10000000"]
    rows = [(i, "LiFePO4" if i % 3 == 0 else odd[i % len(odd)], odd[(7 * i) % len(odd)]) for i in range(300)]
    df = spark.createDataFrame(rows, "row int, a string, b string").repartition(5)
    want = {tuple(map(str, r)) for r in parse_formulas(df, pa="a", pb="b").collect()}
    got = {tuple(map(str, r)) for r in parse_distinct(df, ["row"], pa="a", pb="b").select("row", "a", "b", "pa", "pb").collect()}
    assert got == {tuple(map(str, r)) for r in parse_formulas(df, pa="a", pb="b").select("row", "a", "b", "pa", "pb").collect()} and len(want) == 300
    assert formula_table(df, ["a", "b"]).count() == len(set(odd) - {None})


def test_rows_of_a_lookup_hold_no_parser(spark):
    from ionforge.operators.formulas import parse_distinct
    df = spark.createDataFrame([(1, "LiFePO4")], "row int, a string")
    plan = parse_distinct(df, ["row"], pa="a")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan
