"""Column helpers shared by the operators of this subpackage."""

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark, sf_dir, table="documents"):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(column="text"):
    return F.coalesce(F.col(column), F.lit(""))


def fold(column, parts):
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % parts


@F.arrow_udf(StringType())
def ascii_lower(text: pa.Array) -> pa.Array:
    """Lower-case A-Z and nothing else; null becomes the empty text."""
    return pc.ascii_lower(pc.fill_null(text, ""))


def lowered(text):
    """A-Z in lower case and nothing else, inside the JVM; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rowed(df, **working):
    """Each row packed into the struct ``row`` beside working columns, which then can't clash with the table's own."""
    return df.select(F.struct("*").alias("row"), *[column.alias(name) for name, column in working.items()])


def slices(sizes, most):
    """Cut rows of the given sizes into consecutive ranges of about ``most`` units, one row at least."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)
