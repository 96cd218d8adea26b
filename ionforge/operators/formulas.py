"""The distinct formulas of a table with their parse.

Formulas are parsed where their rows are (``functions/composition.py``): looking
them up in a table of the distinct ones would shuffle the rows once per formula
column, and distinct formulas grow with the rows.

Defined results: a null formula isn't in the table; a formula that doesn't parse
has its error and null parts; a null ion removes no element.
"""

from pyspark.sql import functions as F

from ionforge.functions.composition import host_key, parse_formulas, reduce_composition, with_host
from ionforge.session import stored

ION = "__ion"


def formula_table(rows, columns, ion=None):
    """Distinct formulas of some columns with their parse, reduced composition and key, and their host for each ion."""
    keys = ["formula"] + ([ION] if ion else [])
    own = [F.explode(F.array(*[F.col(c) for c in columns])).alias("formula")] + ([F.coalesce(F.col(ion), F.lit("")).alias(ION)] if ion else [])
    counted = rows.select(*own).where(F.col("formula").isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    found = parse_formulas(counted, parsed="formula")
    if ion:
        found = with_host(found, ION, host="parsed.comp")
    found = reduce_composition(found, reduced="parsed.comp").withColumn("key", host_key("reduced"))
    parts = ["parsed", "reduced", "key"] + (["host"] if ion else [])
    return stored(found.select(*keys, "n", F.struct(*parts).alias("found")), "formulas")


def parse_distinct(rows, spread, **columns):
    """``parse_formulas``; a task parses a formula once while it remembers it. ``spread`` is not needed any more."""
    return parse_formulas(rows, **columns)
