"""Session defaults and cluster-safe helpers (checkpoint folder, shipped code)."""

from __future__ import annotations

import os
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent

# Session settings every job here relies on: AQE re-plans joins from runtime
# sizes (a shuffled side that turns out small becomes a broadcast), splits
# skewed partitions, and coalesces small shuffle partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    # text rows are large and their per-row work is CPU heavy: smaller input splits and
    # shuffle partitions of about 64 MiB keep tasks short and within executor memory
    "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024),
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(64 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "tagweave", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the defaults above.

    On a cluster pass ``master=None`` and let spark-submit decide; tests pass
    ``local[*]`` and a small shuffle partition count.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_code(spark)
    return spark


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, so that Python tasks find it wherever the driver was started.

    Not needed where the package is installed on every node; sent once per application. The archive stays in
    the driver's own Spark folder, from where executors fetch it.
    """
    from pyspark import SparkFiles
    sc = spark.sparkContext
    if spark.conf.get("tagweave.shipped", "") == sc.applicationId:
        return
    folder = os.path.join(SparkFiles.getRootDirectory(), "code")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{PACKAGE.name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE.parent))
    sc.addPyFile(path)
    spark.conf.set("tagweave.shipped", sc.applicationId)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: ``spark.checkpoint.dir``, else one beside the warehouse tables.

    Both are folders every executor sees; a machine-local temporary folder is never used.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc.setCheckpointDir(path or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: its plan is cut there.

    Iterative operators call this every round, so that a lost executor rereads the last round instead of
    recomputing the first. (A checkpointed plan keeps what the optimizer inferred about its columns, and over
    a dozen rounds that grows without bound; a table that is read back keeps nothing.)
    """
    path = write_shared(df, "cut")
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete tables of :func:`cut_lineage` that no later step reads."""
    for df in tables:
        path = getattr(df, "_shared_path", None)
        release(*getattr(df, "_parts", ()))
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_shared(df: DataFrame, tag: str) -> str:
    """Write ``df`` as Parquet into the shared checkpoint folder and return the path.

    What reads the table does not need what it was made from, so the shuffle files of the job are removed when it
    ends (``CLEANUP``), not whenever the driver's garbage collector happens to run."""
    conf = df.sparkSession.conf
    path = f"{checkpoint_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex[:12]}"
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return path


@contextmanager
def arrow_rows(spark: SparkSession, n: int):
    """Arrow batches of at most ``n`` rows for the jobs inside: both sides of the pipe hold a batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(n, int(before)) if int(before) > 0 else n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def reuse(df: DataFrame) -> DataFrame:
    """Persist an input that an operator reads more than once (memory, spilling to disk).

    A lost executor recomputes only its partitions from lineage.
    """
    from pyspark import StorageLevel
    return df.persist(StorageLevel.MEMORY_AND_DISK)


SPREAD_ROWS = 4096   # rows of text that one task takes


def spread(df: DataFrame, min_partitions: int | None = None, rows: int | None = None) -> DataFrame:
    """Round-robin ``df`` over at least ``min_partitions`` tasks of about ``rows`` rows when its scan deals it worse.

    Row-local work (cleaning, per-document arrays, parsing) only runs as wide as the scan, and the scan only as wide
    as the row groups of the files: a large file of one row group has many splits, but one of them reads all rows.
    So the rows of each split are counted (from the files' footers, no column is read). Where no split has more than
    twice ``rows`` and there are splits enough, nothing is moved.
    """
    rows = rows or SPREAD_ROWS
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    counts = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
    splits, most, n = counts.agg(F.count(F.lit(1)), F.max("n"), F.sum("n")).first()
    if splits >= target and most <= 2 * rows or not n:
        return df
    return df.repartition(max(target, -(-n // rows)))
