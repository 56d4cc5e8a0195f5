"""Ids seen by the batches of a stream, as sorted runs that are merged by levels.

Batch ``n`` adds one run of its ids, sorted, so that Parquet's statistics skip the row groups outside the ids asked
for. ``FAN`` runs of a level become one of the next: after n batches at most ``(FAN - 1) * log_FAN(n)`` runs are
read, however many batches there were, and every id is written once a level.

Which runs hold the batches before ``n`` follows from ``n`` alone (its digits to base ``FAN``), so nothing is listed
and no manifest can be torn: a run is written whole before a later batch reads it, and a batch that is run again
reads what it read before and replaces its own runs. Runs that were merged are deleted by the batch after, when the
one that merged them can no longer be repeated. Batches are numbered from 0 without gaps, as ``foreachBatch`` does;
a run that is missing is an error, not an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAN = 8


def runs_before(n: int) -> list[tuple[int, int]]:
    """(level, first batch) of the runs that hold batches 0 to n - 1, largest first."""
    out, at, level = [], 0, 0
    while FAN ** (level + 1) <= n:
        level += 1
    while at < n:
        while at + FAN ** level > n:
            level -= 1
        out.append((level, at))
        at += FAN ** level
    return out


def _path(folder: str, run: tuple[int, int]) -> str:
    return f"{folder}/level={run[0]}/first={run[1]}"


def ids_before(spark: SparkSession, folder: str, n: int, ids: DataFrame) -> DataFrame | None:
    """The distinct ``page_id`` of batches before ``n`` between the smallest and the largest of ``ids``; None if there
    can be none."""
    lo, hi = ids.agg(F.min("page_id"), F.max("page_id")).first()
    if n == 0 or lo is None:
        return None
    runs = spark.read.schema("page_id long").parquet(*[_path(folder, r) for r in runs_before(n)])
    return runs.where(F.col("page_id").between(lo, hi))


def add_ids(ids: DataFrame, folder: str, n: int) -> None:
    """Write the run of batch ``n`` and merge the levels it completes."""
    spark = ids.sparkSession

    def write(rows: DataFrame, run):
        (rows.repartitionByRange("page_id").sortWithinPartitions("page_id")
             .write.mode("overwrite").parquet(_path(folder, run)))

    write(ids.select("page_id").where(F.col("page_id").isNotNull()).distinct(), (0, n))
    level = 1
    while (n + 1) % FAN ** level == 0:
        size = FAN ** (level - 1)
        first = n + 1 - FAN * size
        parts = [_path(folder, (level - 1, first + i * size)) for i in range(FAN)]
        write(spark.read.schema("page_id long").parquet(*parts), (level, first))
        level += 1


def drop_merged(spark: SparkSession, folder: str, n: int) -> None:
    """Delete the runs that batch ``n - 1`` merged: batch ``n`` starts only when that one is done for good."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    level = 1
    while n and n % FAN ** level == 0:
        size = FAN ** (level - 1)
        for i in range(FAN):
            p = jvm.org.apache.hadoop.fs.Path(_path(folder, (level - 1, n - FAN * size + i * size)))
            p.getFileSystem(conf).delete(p, True)
        level += 1
