"""Plan-shape checks: the scale properties the README claims, read from the physical plans."""

import re

from pyspark.sql import functions as F

from conftest import SF001
from tagweave.operators.features import prepare_documents
from tagweave.operators.keywords import keyword_tags
from tagweave.operators.rules import match_rules
from tagweave.sources.pages import drop_internal_urls


def _plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def _docs(spark, n_files_like_cluster=True):
    # read without the single-split spread, as a large scan on a cluster would
    raw = spark.read.parquet(f"{SF001}/documents.parquet").repartition(4)
    return prepare_documents(raw)


def test_keyword_tags_has_no_shuffle_after_the_scan(spark):
    docs = _docs(spark)
    plan = _plan(keyword_tags(docs))
    exchanges = re.findall(r"Exchange (\w+)", plan.split("== Initial Plan ==")[0])
    assert exchanges == ["RoundRobinPartitioning"]   # only the test's own repartition


def test_rules_need_no_join(spark):
    docs = _docs(spark).select("doc_id", F.lit("t").alias("title"), F.lit("c").alias("content"),
                               F.array().cast("array<string>").alias("tags"))
    plan = _plan(match_rules(docs, [(1, "A", [(3, 1, "c")]), (2, "B", [])]))
    assert "Join" not in plan


def test_filters_reach_the_scan(spark):
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    plan = _plan(drop_internal_urls(pages).select("page_id"))
    assert "PushedFilters: [" in plan and "Not(StringStartsWith(url,chrome-extension://))" in plan
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan


def test_checkpoint_folder_comes_from_the_session(spark):
    from tagweave.session import checkpoint_dir
    assert checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()
