"""A training corpus from raw documents: five stages, each applying one operator to all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again. All but the last return the columns of documents.

- ``toxicity`` drops documents with a toxicity of the threshold or more; null
  and empty texts have the bias' score.
- ``exact_dedup`` keeps the row with the smallest id of equal texts (A-Z in
  lower case); null counts as empty.
- ``simhash_dedup`` keeps the row with the smallest id of each near-duplicate
  group: five-word shingles, Jaccard similarity of 0.8 or more, found by SimHash.
- ``mixing`` samples by calibrated probabilities; documents without tokens stay.
- ``bpe`` returns id, source, language, text, token ids and their number.

Each stage handles null ids, repeated rows and extra columns as its operator
states; an empty table passes through.
"""

import public_tokenizers
from pyspark.sql import functions as F

from ionforge.llm import bpe, exact_dedup, mixing, simhash_near, toxicity
from ionforge.llm.common import documents
from ionforge.session import scratch_path

#: Learning, sampling and similarity can't be written in SQL.
ORACLE_SQL = None


def drop_toxic(spark, docs, sf_dir):
    settings = toxicity.Settings()
    machine = toxicity.fit(docs, documents(spark, sf_dir, "labels"), settings)
    scored = toxicity.score(docs, machine, score_col="__toxicity")
    return scored.where(F.col("__toxicity") < settings.threshold).select(*docs.columns)


def drop_copies(spark, docs, sf_dir):
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark, docs, sf_dir):
    return simhash_near.deduplicate(docs)


def mix(spark, docs, sf_dir):
    return mixing.sample(docs)


def tokenize(spark, docs, sf_dir):
    encoded = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return encoded.select("doc_id", "source", "lang", "text", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix),
    ("bpe", tokenize),
]


def run(spark, sf_dir):
    """Apply all stages to the documents of a folder; every stage's result is a written table."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
