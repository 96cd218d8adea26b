"""Identity: canonical fingerprints, row ids and order-free digests."""

from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_text(df, columns):
    """Key-sorted, typed, length-prefixed text of a record; nulls are tagged, never dropped."""
    parts = []
    for name in sorted(columns):
        dtype = df.schema[name].dataType
        if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
            text, tag = F.to_json(F.col(name), {"ignoreNullFields": "false"}), "j"
        elif isinstance(dtype, T.StringType):
            text, tag = F.col(name), "s"
        elif isinstance(dtype, T.BooleanType):
            text, tag = F.col(name).cast("string"), "b"
        elif isinstance(dtype, T.IntegralType):
            text, tag = F.col(name).cast("string"), "i"
        else:
            text, tag = F.col(name).cast("string"), "d"
        tagged = F.concat(F.lit(tag), F.length(text).cast("string"), F.lit(":"), text)
        parts.append(F.concat(F.lit(f"{name}="), F.coalesce(tagged, F.lit("n")), F.lit(";")))
    return F.concat(*parts)


def fingerprint(df, columns):
    return F.sha2(canonical_text(df, columns), 256)


def row_uid(record_key, interval_index):
    return F.sha2(F.to_json(F.array(record_key, interval_index)), 256)


def seeded_hash(seed, salt, key):
    """SHA-256 of the JSON text ``[seed,"salt","key"]``."""
    return F.sha2(F.concat(F.lit(f'[{seed},"{salt}","'), key.cast("string"), F.lit('"]')), 256)


def _hash_number(value):
    return F.conv(F.substring(F.sha2(value, 256), 1, 15), 16, 10).cast("decimal(38,0)")


def set_digest(value):
    """Commutative digest of a set of ids: (count, sum of 60-bit hash prefixes) as text."""
    total = F.coalesce(F.sum(_hash_number(value)), F.lit(0).cast("decimal(38,0)"))
    return F.concat(F.count(value).cast("string"), F.lit(":"), total.cast("string"))
