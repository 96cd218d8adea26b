"""Strict text tables and the fixed-layout interval, split and feature tables."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionforge.constants import INTERVAL_FIELDS
from ionforge.rules import flag_text


def read_strict_csv(spark, path, required=()):
    """All-text CSV: unique headers, no missing columns, no short or surplus rows in any file."""
    head = spark.read.option("header", False).option("escape", '"').csv(path).limit(1).collect()
    names = [v for v in head[0]] if head else []
    if not names or any(not n for n in names) or len(set(names)) != len(names):
        raise ValueError("CSV has missing or duplicate headers")
    missing = sorted(set(required) - set(names))
    if missing:
        raise ValueError("missing CSV columns: " + ", ".join(missing))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = (spark.read.schema(schema).option("header", True).option("enforceSchema", False)
            .option("mode", "FAILFAST").option("escape", '"').option("nullValue", "\u0000").option("emptyValue", "").csv(path))
    return rows.fillna("")


def _flat(rows, columns):
    kinds = dict(rows.dtypes)
    return rows.select(*[flag_text(c).alias(c) if kinds[c].startswith("array") else F.col(c) for c in columns])


def write_interval_tables(rows, path, columns=INTERVAL_FIELDS, fmt="csv"):
    """Fixed column order with flag arrays flattened to ``;`` text."""
    writer = _flat(rows, columns).write.mode("errorifexists")
    if fmt == "csv":
        writer.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    else:
        writer.format(fmt).save(path)
    return path


def write_split_tables(rows, path, model, order=("row_uid", "source_row")):
    """Rows of a model partitioned by partition and sorted by identity inside each file.

    Range partitioning keeps the order global and splits a dominant partition
    over many tasks. A rerun replaces the model's tables and leaves the others.
    """
    (rows.repartitionByRange("partition", *order).sortWithinPartitions("partition", *order)
     .write.mode("overwrite").partitionBy("partition").parquet(f"{path}/model={model}"))
    return path


def review_queue(rows, flagged):
    """Rows a reviewer must look at, with blank decision columns."""
    return rows.where(flagged).withColumns({"review_decision": F.lit("pending"), "evidence_reference": F.lit(""),
                                            "reviewer_notes": F.lit("")})


SCHEMA_TAG = "schema_hash"


def write_feature_table(features, path, schema_hash, vector="val"):
    """Feature rows with the feature-schema hash kept in the column metadata."""
    tagged = features.withMetadata(vector, {SCHEMA_TAG: schema_hash})
    tagged.write.mode("errorifexists").partitionBy("model", "role").parquet(path)
    return path


def read_feature_table(spark, path, schema_hash, vector="val"):
    rows = spark.read.parquet(path)
    if rows.schema[vector].metadata.get(SCHEMA_TAG) != schema_hash:
        raise ValueError("feature table was written for another feature schema")
    return rows


def csv_safe(predictions, text_columns=None):
    """Nulls to empty text, text that a spreadsheet would run gets a quote; numbers stay as they are."""
    out = {}
    for name, dtype in predictions.dtypes:
        col = F.col(name)
        if dtype.startswith("array"):
            col, dtype = F.array_join(col, " | "), "string"
        if dtype == "string":
            col = F.when(col.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), col)).otherwise(col)
        out[name] = F.coalesce(col.cast("string"), F.lit(""))
    return predictions.select(*[c.alias(n) for n, c in out.items()])
