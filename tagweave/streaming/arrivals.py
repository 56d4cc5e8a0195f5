"""Tag pages as they arrive, each page once.

Pages land as parquet files in a folder. Each micro-batch drops internal
URLs, skips pages tagged by an *earlier* batch, tags the rest and writes three
tables under ``out_dir``, each with mode overwrite into its own
``batch_id=N`` folder: ``pages`` (the ids tagged), ``tags`` (keyword tags) and
``entities`` (entity tags). Which ids are tagged is kept in ``out_dir/seen``
as sorted runs merged by levels (:mod:`tagweave.streaming.seen`).

A retried batch N reads only what batches below N wrote, so it computes the
same rows again and replaces its own output: nothing is lost or doubled. Pages
without an id cannot be told apart: each micro-batch keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave import schemas
from tagweave.plans.tag_pages import entity_tags_of, tag_pages
from tagweave.session import reuse
from tagweave.streaming import seen


def tag_batch(batch: DataFrame, batch_id: int, out_dir: str, gazetteer: DataFrame | None = None,
              threshold: float = 0.2) -> None:
    """Tag one micro-batch, write its three tables and add its ids to the index."""
    spark, index = batch.sparkSession, f"{out_dir}/seen"
    seen.drop_merged(spark, index, batch_id)
    before = seen.ids_before(spark, index, batch_id, batch)
    before = before.select(F.col("page_id").alias("doc_id")) if before is not None else None
    tags, fields = tag_pages(batch.dropDuplicates(["page_id"]), before, threshold)
    fields = reuse(fields)  # parsed once for the three tables
    part = f"batch_id={batch_id}"
    tags, _ = tag_pages(None, None, threshold, fields=fields)
    tags.write.mode("overwrite").parquet(f"{out_dir}/tags/{part}")
    entity_tags_of(fields, gazetteer).write.mode("overwrite").parquet(f"{out_dir}/entities/{part}")
    fields.select("page_id").write.mode("overwrite").parquet(f"{out_dir}/pages/{part}")
    seen.add_ids(fields, index, batch_id)
    fields.unpersist()


def tag_arrivals(spark: SparkSession, pages_dir: str, out_dir: str, checkpoint: str, threshold: float = 0.2,
                 max_files_per_trigger: int = 1, available_now: bool = True, gazetteer: DataFrame | None = None):
    """Start the stream; returns the ``StreamingQuery`` (``available_now`` drains the folder and stops)."""
    stream = (spark.readStream.schema(schemas.PAGES)
                   .option("maxFilesPerTrigger", max_files_per_trigger).parquet(pages_dir))
    writer = (stream.writeStream.foreachBatch(lambda b, n: tag_batch(b, n, out_dir, gazetteer, threshold))
                    .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
