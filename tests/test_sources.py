import os

import pytest

from ionforge.sources import records, runs, snapshot, tables


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_torn_tail(spark, tmp_path):
    read = lambda p: records.read_jsonl_torn_tail(spark, p, "a int")
    good, issues = read(write(tmp_path / "x.jsonl", '{"a": 1}\n\n{"a": 2}\n{"a": '))
    assert sorted(r.a for r in good.collect()) == [1, 2] and issues.count() == 1
    good, _ = read(write(tmp_path / "y.jsonl", '{"a": \n{"a": 2}\n'))
    with pytest.raises(Exception, match="damaged line"):
        good.collect()
    good, _ = read(write(tmp_path / "z.jsonl", '{"a": 1}\n[3]\n'))
    with pytest.raises(Exception, match="not an object"):
        good.collect()


def test_strict_json_rejects_arrays(spark, tmp_path):
    with pytest.raises(Exception):
        records.read_records(spark, write(tmp_path / "a.jsonl", '{"a": 1}\n[1]\n'), "a int").collect()


def test_strict_csv(spark, tmp_path):
    read = lambda name, text, *need: tables.read_strict_csv(spark, write(tmp_path / name, text), need).collect()
    assert [tuple(r) for r in read("a.csv", '﻿a,b\n1,"x ""y"", z"\n,\n')] == [("1", 'x "y", z'), ("", "")]
    for name, text, need in (("b.csv", "a,a\n1,2\n", ()), ("c.csv", "a,b\n1\n", ()), ("d.csv", "a,b\n1,2,3\n", ()), ("e.csv", "a,b\n1,2\n", ("c",))):
        with pytest.raises(Exception):
            read(name, text, *need)


def test_csv_safe(spark):
    df = spark.createDataFrame([("=1+1", -2.5, ["a", "b"]), (None, None, None), ("ok-", 1.0, [])], "t string, v double, w array<string>")
    assert [tuple(r) for r in tables.csv_safe(df).collect()] == [("'=1+1", "-2.5", "a | b"), ("", "", ""), ("ok-", "1.0", "")]


def test_manifest_notices_changes(spark, tmp_path):
    path = str(tmp_path / "out")
    spark.range(10).repartition(2).write.parquet(path)
    files = runs.file_manifest(spark, path)
    before = spark.createDataFrame(files.collect(), files.schema)
    assert before.count() == 2
    victim = before.first()["path"].replace("file:", "")
    folder, name = os.path.split(victim)
    os.remove(f"{folder}/.{name}.crc")
    with open(victim, "ab") as handle:
        handle.write(b"x")
    status = [r.status for r in runs.verify_manifest(before, runs.file_manifest(spark, path), path).collect()]
    assert sorted(status) == ["changed", "ok"]


def test_publish_is_idempotent_and_refuses_incomplete(spark, tmp_path):
    root = str(tmp_path)
    write_ok = lambda p: spark.range(3).write.parquet(p)
    rid = runs.run_id("r", "abcdef0123456789", {"a": 1})
    assert rid == runs.run_id("r", "abcdef0123456789", {"a": 1}) != runs.run_id("r", "abcdef0123456789", {"a": 2})
    assert runs.publish_run(spark, root, rid, write_ok)[1] is False
    assert runs.publish_run(spark, root, rid, write_ok)[1] is True
    (tmp_path / "broken" / "data").mkdir(parents=True)
    with pytest.raises(ValueError, match="incomplete"):
        runs.publish_run(spark, root, "broken", write_ok)


def test_page_log(spark):
    good = [("a", 0, 2, 5), ("a", 2, 3, 5)]
    bad = [("gap", 0, 2, 5), ("gap", 3, 3, 5), ("twice", 0, 2, 4), ("twice", 0, 2, 4), ("late", 1, 2, 2), ("zero", 0, 0, 0), ("total", 0, 2, 3)]
    df = spark.createDataFrame(good + bad, "g string, skip bigint, count bigint, total bigint")
    got = {r.g: r.complete for r in snapshot.page_log_gaps(df, ["g"]).collect()}
    assert got == {"a": True, "gap": False, "twice": False, "late": False, "zero": False, "total": False}


def test_feature_table_refuses_another_schema(spark, tmp_path):
    df = spark.createDataFrame([([1], [2.0], "m", "r")], "idx array<int>, val array<double>, model string, role string")
    path = tables.write_feature_table(df, str(tmp_path / "f"), "hash1")
    assert tables.read_feature_table(spark, path, "hash1").count() == 1
    with pytest.raises(ValueError):
        tables.read_feature_table(spark, path, "hash2")
