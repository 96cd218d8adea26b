"""The corpus pipeline: every stage against a plain version of it on small documents."""

import re

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from ionforge.llm import bpe, mixing  # noqa: E402

WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n=60):
    return " ".join(WORDS[(seed * 131 + i * i * 7 + i * 3) % 400] for i in range(n))


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = [], []
    for i in range(160):
        nasty = i % 5 == 0
        rows.append((i, prose(i) + (" zorble vexmuck zorble" if nasty else "")))
        labels.append((i, int(nasty)))
    rows += [(200 + i, prose(i).upper() if i % 2 else prose(i)) for i in range(1, 9)]            # exact copies
    rows += [(300 + i, prose(i) + " tail") for i in range(1, 9)]                                  # near copies
    rows += [(400, None), (401, ""), (402, "  \n"), (403, "zorble vexmuck " * 2), (None, prose(3) + " x y z q r s t"), (7, prose(7))]
    table = spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else "de", None if i == 9 else f"s{(i or 0) % 3}", len(t or "")) for i, t in rows],
                                  "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, x) for i, x in labels], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, sf_dir)
        out.append((name, docs.collect(), kept.collect(), docs.columns, kept.columns))
        path = f"{sf_dir}/{name}"
        kept.write.parquet(path)
        docs = spark.read.parquet(path)
    return {name: rest for name, *rest in out}


def test_order_and_columns(steps):
    assert list(steps) == ["toxicity", "exact_dedup", "simhash_dedup", "mixing", "bpe"]
    for name in list(steps)[:-1]:
        before, after, columns, kept = steps[name]
        assert columns == kept and after and not set(map(tuple, after)) - set(map(tuple, before))


def test_toxic_documents_go_and_clean_ones_stay(steps):
    before, after, *_ = steps["toxicity"]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert gone == {r.doc_id for r in before if "zorble" in (r.text or "")}


def test_one_of_equal_texts_stays(steps):
    before, after, *_ = steps["exact_dedup"]
    best = {}
    for r in before:
        best.setdefault(low(r.text), []).append(r.doc_id)
    first = lambda ids: min((i for i in ids if i is not None), default=None)
    assert sorted((low(r.text), r.doc_id) for r in after if r.doc_id is not None) == sorted((t, first(i)) for t, i in best.items() if first(i) is not None)
    assert len(after) == len(best)


def test_one_of_near_copies_stays(steps):
    before, after, *_ = steps["simhash_dedup"]
    sets = [shingles(r.text) for r in before]
    group = list(range(len(before)))
    for i in range(len(before)):
        for j in range(i):
            if sets[i] == sets[j] or sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    best = {}
    for r, g in zip(before, group):
        best.setdefault(g, []).append(r.doc_id)
    want = [min((i for i in ids if i is not None), default=None) for ids in best.values()]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in after) == sorted((i is None, i or 0) for i in want)
    assert len(after) < len(before)


def test_mixing_keeps_by_its_own_decision(spark, steps):
    before, after, columns, _ = steps["mixing"]
    docs = spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in mixing.decide(docs).where("sampled").collect()}
    assert {r.doc_id for r in after} == kept and {r.doc_id for r in before if not (r.text or "").strip()} <= kept


def test_tokens_are_those_of_the_vocabulary(steps):
    before, after, *_ = steps["bpe"]
    v = bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    assert len(after) == len(before)
    for r in after:
        ids, size = v.encode([r.text or ""])
        assert list(r.token_ids) == ids.tolist() and r.n_tokens == size[0]


def test_run_returns_the_last_stage(spark, sf_dir, steps):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(map(str, rows)) == sorted(map(str, steps["bpe"][1])) and corpus_pipeline.ORACLE_SQL is None


def test_an_empty_table_passes_through(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
