"""File manifests and content-addressed runs."""

import hashlib
import json

from pyspark.sql import functions as F

MANIFEST = "_manifest"


def file_manifest(spark, path):
    """SHA-256 and length of every file below ``path`` (one task per file, part-file sized)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", "[!_.]*").load(path))
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _plain(path):
    """A path with one spelling of the local scheme; any step upwards makes it fall outside every root."""
    plain = F.regexp_replace(path, "^file:/+", "/")
    return F.when(~F.concat(plain, F.lit("/")).contains("/../"), F.regexp_replace(plain, r"(?<!:)/(\./|/)+", "/")).otherwise("")


def verify_manifest(expected, actual, root):
    """Status per path: ok, changed, missing, unexpected or outside_root."""
    both = expected.select("path", F.col("sha256").alias("want")).join(
        actual.select("path", F.col("sha256").alias("have")), "path", "full_outer")
    inside = _plain(F.col("path")).startswith(_plain(F.lit(root.rstrip("/") + "/")))
    status = (F.when(F.col("want").isNotNull() & ~inside, "outside_root").when(F.col("have").isNull(), "missing")
              .when(F.col("want").isNull(), "unexpected").when(F.col("want") != F.col("have"), "changed").otherwise("ok"))
    return both.select("path", status.alias("status"))


def run_id(prefix, input_digest, config):
    text = json.dumps(config, sort_keys=True, separators=(",", ":"))
    return f"{prefix}_{input_digest[:10]}_{hashlib.sha256(text.encode()).hexdigest()[:8]}"


def publish_run(spark, root, rid, write):
    """Write a run once; a complete run is verified and reused, an incomplete one refused.

    ``write(path)`` produces the outputs; the manifest table is written last
    and marks the run complete.  Returns ``(path, reused)``.
    """
    path = f"{root.rstrip('/')}/{rid}"
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        if not fs.exists(hadoop.Path(f"{path}/{MANIFEST}/_SUCCESS")):
            raise ValueError("an incomplete run exists and was left untouched: " + path)
        checked = verify_manifest(spark.read.parquet(f"{path}/{MANIFEST}"), file_manifest(spark, f"{path}/data"), path)
        if not checked.where("status <> 'ok'").isEmpty():
            raise ValueError("outputs of a complete run were changed: " + path)
        return path, True
    write(f"{path}/data")
    file_manifest(spark, f"{path}/data").write.parquet(f"{path}/{MANIFEST}")
    return path, False


def latest_complete_run(runs, group=(), status="status", run="run_id", path="path"):
    """Newest complete run; an ungrouped call fails when there is none."""
    done = runs.where(F.col(status) == "complete")
    if group:
        return done.groupBy(*group).agg(F.max_by(path, run).alias("path"), F.max(run).alias("run_id"))
    best = done.agg(F.max_by(path, run).alias("path"), F.max(run).alias("run_id"))
    return best.withColumn("run_id", F.coalesce("run_id", F.raise_error(F.lit("no complete run"))))
