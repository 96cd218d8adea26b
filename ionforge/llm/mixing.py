"""Mixing by iterative proportional fitting: rake token weights to marginals, then sample documents.

Documents fall into cells of source, language and topic. The cells' token
shares are scaled to the target share of every source, then language, then
topic, and again, until all marginals fit. A cell's calibrated weight is its
raked share over its natural share; a document stays with a probability in
proportion to it, at most 1, decided by a hash of its id. In expectation the
kept tokens then have exactly the target marginals. All of it is DataFrame
operations over tables that Spark aggregates.

Targets default to the natural shares raised to ``temper`` and scaled to one.

Defined results: null source, language or topic is a category of its own; null
and empty texts have no tokens, take part in no cell's weight and stay; rows
with the same id share one decision, and a null id counts as the empty text; a
category with a target but no tokens is left out, one without a target keeps
its natural share, and both are scaled to one; targets that no weights can meet
leave the state after ``max_rounds``; a table without tokens keeps every row. Extra columns stay, working columns are private.
"""

from functools import reduce

from pyspark.sql import functions as F

from ionforge.llm.common import rowed
from ionforge.session import stored

DIMENSIONS = ("source", "lang", "topic")
TEMPER = 0.9
TOLERANCE = 1e-10
MAX_ROUNDS = 60
SEED = "mix"


def token_count(text):
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic_of(text):
    """Kind of content from literal marks; the first that occurs counts."""
    marks = (("contact", ("@",)), ("table", (" | ",)), ("noise", ("%%%", "&&&", "$$$", "***", "###")), ("shout", ("!!",)))
    cases = [(name, reduce(lambda a, b: a | b, [text.contains(m) for m in found])) for name, found in marks]
    first, *rest = cases
    return reduce(lambda col, case: col.when(case[1], case[0]), rest, F.when(first[1], first[0])).otherwise("prose")


def profile(docs):
    """Id, category keys and token count of every document. A key tells null from any text."""
    text = F.col("text")
    values = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(F.coalesce(text, F.lit("")))}
    tagged = [F.when(v.isNull(), "n").otherwise(F.concat(F.lit("v"), v.cast("string"))).alias(k) for k, v in values.items()]
    return docs.select("doc_id", *tagged, token_count(text).alias("tokens"))


def targets(cells, dimension, given, temper):
    """Target share of every category of a dimension that has tokens."""
    own = cells.groupBy(dimension).agg(F.sum("share").alias("natural"))
    if given is None:
        wanted = own.withColumn("target", F.pow("natural", F.lit(temper)))
    else:
        rows = [("n" if k is None else f"v{k}", float(v)) for k, v in given.items()]
        table = cells.sparkSession.createDataFrame(rows, f"{dimension} string, asked double")
        wanted = own.join(table, dimension, "left").withColumn("target", F.coalesce("asked", "natural"))
    total = wanted.agg(F.sum("target")).first()[0]
    return wanted.select(dimension, (F.col("target") / total).alias("target"))


def raked(cells, wanted, tolerance=TOLERANCE, max_rounds=MAX_ROUNDS):
    """Scale ``weight`` of the cells round after round until every marginal is within the tolerance."""
    for turn in range(1, max_rounds + 1):
        gaps = []
        for d in DIMENSIONS:
            sums = cells.groupBy(d).agg(F.sum("weight").alias("now"))
            factor = sums.join(wanted[d], d).select(d, F.coalesce(F.try_divide("target", "now"), F.lit(0.0)).alias("factor"))
            cells = cells.join(factor, d).withColumn("weight", F.col("weight") * F.col("factor"))
            gaps.append(F.abs(F.col("factor") - 1))
            cells = cells.withColumn("gap", F.greatest(F.lit(0.0) if len(gaps) == 1 else F.col("gap"), gaps[-1])).drop("factor")
        cells = stored(cells, f"raked-{turn}")
        if (cells.agg(F.max("gap")).first()[0] or 0.0) <= tolerance:
            break
    return cells.drop("gap")


def rates(docs, given=None, temper=TEMPER, rows=None):
    """Per cell: natural share, raked weight, calibrated ratio and keeping probability."""
    rows = profile(docs) if rows is None else rows
    cells = rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")).where(F.col("tokens") > 0)
    cells = stored(cells, "mix-cells")
    total = cells.agg(F.sum("tokens")).first()[0]
    if not total:
        return cells.select(*DIMENSIONS, *[F.lit(1.0).alias(c) for c in ("share", "weight", "ratio", "probability")])
    cells = stored(cells.select(*DIMENSIONS, (F.col("tokens") / total).alias("share")).withColumn("weight", F.col("share")), "mix-shares")
    wanted = {d: stored(targets(cells, d, (given or {}).get(d), temper), f"mix-{d}") for d in DIMENSIONS}
    cells = raked(cells, wanted).withColumn("ratio", F.col("weight") / F.col("share"))
    most = cells.agg(F.max("ratio")).first()[0]
    return cells.withColumn("probability", F.round(F.col("ratio") / most, 9))


def uniform(doc_id, seed=SEED):
    """A number in [0, 1) from a hash of the seed and the id: 48 bits."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)


def decide(docs, given=None, temper=TEMPER, seed=SEED):
    """One row per document: id, cell, tokens, calibrated ratio, probability and whether it is sampled."""
    rows = stored(profile(docs), "mix-profile")
    table = stored(rates(None, given, temper, rows).select(*DIMENSIONS, "ratio", "probability"), "mix-rates")
    joined = rows.join(table, list(DIMENSIONS), "left")
    named = [F.when(F.col(d) != "n", F.expr(f"substring({d}, 2)")).alias(d) for d in DIMENSIONS]
    chance = F.coalesce("probability", F.lit(1.0))
    return joined.select(
        "doc_id", *named, "tokens", F.coalesce("ratio", F.lit(1.0)).alias("ratio"), chance.alias("probability"),
        (uniform(F.col("doc_id"), seed) < chance).alias("sampled"),
    )


def sample(docs, given=None, temper=TEMPER, seed=SEED):
    """The sampled documents with all their columns."""
    table = stored(rates(docs, given, temper).select(*DIMENSIONS, "probability"), "mix-rates")
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(text)}
    tagged = {k: F.when(v.isNull(), "n").otherwise(F.concat(F.lit("v"), v.cast("string"))) for k, v in keys.items()}
    joined = rowed(docs, chance=uniform(F.col("doc_id"), seed), **tagged).join(table, list(DIMENSIONS), "left")
    return joined.where(F.col("chance") < F.coalesce("probability", F.lit(1.0))).select("row.*")
