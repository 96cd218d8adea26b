"""Operators that return whole rows keep every column, whatever its name."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from ionforge.llm import exact_dedup, mixing, simhash, simhash_near, toxicity, url_rules  # noqa: E402

NAMES = (
    "row", "id", "sha256", "of", "keep_id", "group_size", "md5", "body", "copies", "kept", "fp", "root", "component_id", "node", "text_id",
    "near_id", "near_text", "source_", "chance", "probability", "topic", "tokens", "ratio", "url_", "address", "pattern", "token", "size",
    "__id", "__sha", "__text_sha", "__source", "__p", "__near_id", "__near_print", "__url", "__fp", "__root", "__print", "__x",
)
ROWS = [
    (1, "one two three four five six seven eight", "a"), (2, "One two three four five six seven eight", "a"), (2, "One two three four five six seven eight", "a"),
    (3, None, None), (None, "", "b"), (5, "one two three four five six seven eight nine ten eleven twelve", "b"), (6, "nothing like the others at all", "a"),
]
STEPS = {
    "exact": exact_dedup.deduplicate, "simhash": simhash.deduplicate, "near": simhash_near.deduplicate, "mixing": mixing.sample,
    "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, d.select("doc_id", F.lit(1).alias("toxic")))),
}


@pytest.fixture(scope="module")
def docs(spark):
    table = spark.createDataFrame([(i, t, s, "en") for i, t, s in ROWS], "doc_id long, text string, source string, lang string")
    return table.withColumns({n: F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for n in NAMES})


@pytest.mark.parametrize("name", STEPS)
def test_rows_come_back_whole(docs, name):
    got = STEPS[name](docs)
    extra = ["toxicity"] if name == "toxicity" else []
    assert got.columns == docs.columns + extra
    rows = [tuple(r)[: len(docs.columns)] for r in got.collect()]
    known = [tuple(r) for r in docs.collect()]
    assert rows and all(r in known for r in rows)


def test_exact_dedup_keeps_one_of_each(docs):
    assert sorted((r["doc_id"] or 0) for r in exact_dedup.deduplicate(docs).collect()) == [1, 3, 5, 6]
    assert sorted((r["doc_id"] or 0) for r in exact_dedup.deduplicate(docs, keep="largest").collect()) == [2, 3, 5, 6]


def test_judge_replaces_its_own_columns_only(spark):
    pages = spark.createDataFrame([(1, "http://a.example.com/de/x"), (2, None)], "page_id long, url string").withColumns({n: F.lit(n) for n in (*NAMES, "host", "path", "rule", "verdict", "subject", "word")})
    got = url_rules.judge(pages, url_rules.rule_table(spark)).collect()
    assert {(r["page_id"], r["rule"], r["verdict"], r["host"]) for r in got} == {(1, "example.com/de/", "block", "a.example.com"), (2, None, "allow", "")}
    assert all(r[n] == n for r in got for n in NAMES if n not in ("pattern",))
