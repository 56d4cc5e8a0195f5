"""Shared work folder, staged tables and column helpers of the corpus operators."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a set of characters and as a Java regex.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else one beside the warehouse tables."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"


def write_stage(df: DataFrame, tag: str) -> str:
    """Write ``df`` as Parquet into the shared folder and return the path.

    A staged table cuts the lineage: a lost executor rereads it instead of recomputing what came before. So
    the shuffle files of the job that wrote it are removed when it ends (``CLEANUP``), not whenever the
    driver's garbage collector happens to run.
    """
    conf = df.sparkSession.conf
    path = f"{work_dir(df.sparkSession).rstrip('/')}/llm-{tag}-{uuid.uuid4().hex[:12]}"
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return path


def stage(df: DataFrame, tag: str) -> DataFrame:
    """``df``, written to the shared folder and read back."""
    return staged(df, tag)[0]


def staged(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Like ``stage``, with the path, for tables that are dropped when no later step reads them."""
    path = write_stage(df, tag)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_stage(spark: SparkSession, path: str) -> None:
    """Delete a staged table that no later step reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def text_batches(spark: SparkSession) -> None:
    """Arrow batches of 1000 rows: text rows are long, and a task holds a batch on both sides of the pipe."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` alone also maps letters outside ASCII)."""
    ascii_only = F.octet_length(c) == F.char_length(c)
    return F.when(ascii_only, F.lower(c)).otherwise(
        F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def hash128(c: Column) -> list[Column]:
    """Two independent 64-bit hashes of a column: equal pairs stand for equal values."""
    return [F.xxhash64(c), F.xxhash64(F.lit(0x5bd1e995), c)]


def text_of(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def read_docs(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
