"""Line-delimited JSON readers: strict, and tolerant of a torn last line."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ionforge.session import stored


def read_records(spark, path, schema):
    """Strict JSON lines: blank lines are skipped, anything but an object is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _lines(spark, path):
    """All lines with the split they are in; ids grow line by line inside a split."""
    return spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"))


def read_jsonl_torn_tail(spark, path, schema):
    """Records plus issue rows; only the last line of a file may be broken.

    A broken earlier line, or a line holding something other than an object,
    raises.  Returns ``(records, issues)``; an issue names its file and line
    number, counted from 1 with blank lines. One pass counts the lines of each
    split, their prefix sums number them; a second pass gives the records.
    """
    value = F.try_parse_json("line")
    lines = _lines(spark, path).withColumns({"filled": F.col("line").rlike(r"\S"), "broken": value.isNull()}).withColumn("broken", F.col("broken") & F.col("filled"))
    by_split = lines.groupBy("file", "block").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max(F.when(F.col("filled"), F.col("id"))).alias("last"),
        F.count_if("broken").alias("faults"), F.max(F.when(F.col("broken"), F.col("id"))).alias("fault"))
    by_split = stored(by_split, "line-counts")  # one row per split
    order = Window.partitionBy("file").orderBy("block")
    later = F.max(F.when(F.col("last").isNotNull(), F.col("block"))).over(Window.partitionBy("file"))
    placed = by_split.withColumns({"before": F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "end": later})
    torn = (F.col("faults") == 1) & (F.col("block") == F.col("end")) & (F.col("fault") == F.col("last"))
    early = placed.where((F.col("faults") > 0) & ~torn).agg(F.count(F.lit(1))).scalar()
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    fault = (F.when(early > 0, F.raise_error(F.lit("damaged line before the end of the file")))
             .when(~F.col("broken") & ~is_object, F.raise_error(F.lit("line is not an object"))))
    checked = lines.where("filled").withColumn("fault", fault).where(F.coalesce("fault", F.lit("")) == "")
    records = checked.where("not broken").select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    number = (F.col("before") + F.col("fault") - F.col("first") + 1).alias("line")
    return records, placed.where(torn).select(F.lit("discarded_unfinished_line").alias("kind"), "file", number)
