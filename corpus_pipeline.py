"""Corpus pipeline: quality rules, line dedup, near dedup, benchmark decontamination, mixing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the next table. All but
the last return the columns of ``documents``. Every stage works on all rows its predecessor kept:

* ``quality_rules`` drops documents that fail the base rules or the repetition limits,
* ``line_dedup`` drops lines found in ten documents or more from all texts (no document goes),
* ``near_dedup`` keeps the document with the smallest id of each group of near copies (five-word shingles,
  similarity 0.8) and one row of repeated rows,
* ``decontaminate`` drops documents that hold a benchmark item,
* ``mix`` returns how many words the mix takes of each document, with its source's target.

Null texts count as empty (and fail the quality rules); an empty table passes through all stages.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm import decontaminate, line_dedup, mixing, near_dedup, quality_rules
from tagweave.llm.shared import stage

SHINGLE, PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_frequent_lines(docs, min_docs=10, min_chars=1)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, shingle=SHINGLE, percent=PERCENT)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [("quality_rules", quality_stage), ("line_dedup", line_stage), ("near_dedup", near_stage),
          ("decontaminate", decontaminate_stage), ("mix", mix_stage)]

#: Near copies within edit distance and the drawn blocks have no SQL form; tests hold the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
