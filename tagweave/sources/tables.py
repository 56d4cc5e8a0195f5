"""Read the input tables with fixed schemas; conversation documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave import schemas
from tagweave.session import spread

# Tables whose rows carry text: per-row work on them is CPU heavy, so a scan
# with fewer splits than cores is spread before that work starts.
TEXT_TABLES = frozenset(("documents", "pages", "conversations", "benchmark"))


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Read ``{base}/{name}.parquet`` with the table's declared schema.

    Declaring the schema skips inference and lets Catalyst prune columns and
    push filters into the Parquet scan.
    """
    schema = schemas.TABLES.get(name)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(f"{base}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def read_documents(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A batch of documents ``(doc_id, text)`` from parquet, json lines or text files."""
    if fmt == "parquet":
        return spark.read.schema(schemas.DOCUMENTS).parquet(path)
    if fmt == "json":
        return spark.read.schema(schemas.DOCUMENTS).option("mode", "FAILFAST").json(path)
    if fmt == "text":
        # one document per file; the id is a stable hash of the path
        raw = spark.read.text(path, wholetext=True)
        return raw.select(F.xxhash64(F.input_file_name()).alias("doc_id"), F.col("value").alias("text"))
    raise ValueError(f"unknown format {fmt!r}")


def evaluation_corpus(spark: SparkSession, base: str, first_n: int | None = None) -> DataFrame:
    """The evaluation corpus ``(doc_id, text)``, every document; O3: the first ``first_n`` by id if given.

    The cap is an option of the timing script, off by default. With a cap, Spark plans a per-partition top-N
    and a merge.
    """
    docs = read_table(spark, base, "documents").select("doc_id", "text")
    return docs if first_n is None else docs.orderBy("doc_id").limit(first_n)


def conversation_documents(spark: SparkSession, base: str) -> DataFrame:
    """One document per conversation: turn texts joined by newlines, in turn order."""
    conv = read_table(spark, base, "conversations")
    return (conv.groupBy("conv_id")
                .agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
                .select(F.col("conv_id").alias("doc_id"),
                        F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text")))
