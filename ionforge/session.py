"""Session helpers: local test sessions and the shared scratch folder."""

import tempfile
import threading
import uuid
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def local_session(cores="8", name="ionforge", **conf):
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_dir(spark):
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without the setting (a test) gets a temporary folder.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="ionforge-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark, name):
    """A fresh path under the shared folder for one written table."""
    return f"{shared_dir(spark).rstrip('/')}/ionforge-{name}-{uuid.uuid4().hex}"


def exists(spark, path):
    """Whether a file or folder is there, in whatever store the path names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


#: Parquet options for rows of about a MB each: a reader takes thousands of rows of a row group at once, so its groups are small.
SMALL_GROUPS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1"}


def stored(df, name, options=None):
    """Write once to the shared folder and read back.

    Later passes prune columns from the stored table instead of repeating the
    work behind it, and a lost executor re-reads files rather than lineage.
    Hex ids are half of many tables; Zstandard halves them, at its first level as much as at its third.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**{"compression": "zstd", "parquet.compression.codec.zstd.level": "1"} | (options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def balanced(df):
    """Spread a scan with fewer splits than task slots before per-row heavy work.

    A large table already has many splits and passes through unchanged.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


#: Rows of a task that does heavy work for each.
TASK_ROWS = 40_000


def dealt(df, rows=TASK_ROWS):
    """Deal narrow rows out evenly before heavy work for each, at most ``rows`` to a task.

    A file's splits say nothing about its rows: those without the start of a row
    group are empty, so a few tasks would do all the work of a large file.
    """
    return df.repartition(spread(df, rows))


def spread(df, rows=TASK_ROWS):
    """How many tasks to deal the rows of a table to: full waves of all slots, ``rows`` to each task at most.

    A last wave that is nearly empty would be paid by every later pass, as stored tables keep their number of files.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return slots * max(1, -(-df.count() // (rows * slots)))


_FINER = {"lock": threading.Lock(), "open": 0, "before": None}
#: Bytes that are sent to Python at once during a pass.
SENT = 16 << 20


@contextmanager
def finer(spark, waves=3):
    """Cut stored tables into this many tasks per slot while passes are made over them; one a slot leaves a second wave nearly empty.

    What is sent to Python at once is bounded by bytes, as a packed row is worth thousands of plain ones.
    The settings are the session's, so the first of several threads sets them and the last one puts them back.
    """
    wanted = {"spark.sql.files.minPartitionNum": str(waves * spark.sparkContext.defaultParallelism), "spark.sql.execution.arrow.maxBytesPerBatch": str(SENT)}
    with _FINER["lock"]:
        if not _FINER["open"]:
            _FINER["before"] = {name: spark.conf.get(name, None) for name in wanted}
            for name, value in wanted.items():
                spark.conf.set(name, value)
        _FINER["open"] += 1
    try:
        yield
    finally:
        with _FINER["lock"]:
            _FINER["open"] -= 1
            if not _FINER["open"]:
                for name, value in _FINER["before"].items():
                    spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def together(spark, jobs):
    """Call functions that don't wait for each other, each in a thread, so one's passes fill the slots that another's leave; results in order.

    All come to their end before an error of one is raised.
    """
    if not jobs:
        return []
    with ThreadPoolExecutor(len(jobs)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
    return [r.result() for r in running]
