"""A fast selection of the registered queries against DuckDB on the smallest driver tables."""

import os

import pytest

import __spark_entry__ as entry_points

SF = "/root/testdata/sf0.001"
FAST = ("parse_composition", "host_key", "ordered_digest", "page_log_gaps", "repeated_reaction_review", "hash_holdout",
        "balanced_group_folds", "overlap_counts", "regression_metrics", "median_baseline", "profile_contiguity", "resume_pending")


def test_every_query_is_registered_once():
    names, sql = entry_points.queries(), entry_points.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 100


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in os.listdir(SF):
        con.execute(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM '{SF}/{table}'")
    df = entry_points.queries()[name](spark, SF)
    cursor = con.execute(entry_points.oracle_sql()[name])
    order = [c[0] for c in cursor.description]
    assert sorted(order) == sorted(df.columns)
    key = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted((tuple(r[c] for c in order) for r in df.collect()), key=key) == sorted((tuple(r) for r in cursor.fetchall()), key=key)
