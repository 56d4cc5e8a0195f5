"""Plan §3.1, tag pages: pages → fields → drop internal URLs → skip tagged → clean → keyword tags.

One Python pass (page parsing); everything after it is JVM-side and runs in
the page's own row, so the whole flow has no shuffle unless stored tags are
given (then one anti join on ``page_id``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.functions.text import DEFAULT_STOP_WORDS, clean_tokens
from tagweave.operators.entities import default_gazetteer, entity_spans, entity_tags, entity_words
from tagweave.operators.keywords import keyword_tags
from tagweave.sources.pages import drop_internal_urls, extract_page_fields


def tag_pages(pages: DataFrame | None, stored_tags: DataFrame | None = None, threshold: float = 0.2,
              stop_words=DEFAULT_STOP_WORDS, fields: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Returns ``(tags(page_id, rank, tag, score), fields)`` for pages not tagged yet.

    ``fields``: the parsed pages, when the caller already has them.
    """
    if fields is None:
        pages = drop_internal_urls(pages)
        if stored_tags is not None:
            pages = pages.join(stored_tags.select(F.col("doc_id").alias("page_id")), "page_id", "left_anti")
        fields = extract_page_fields(pages)
    docs = fields.select(F.col("page_id").alias("doc_id"),
                         clean_tokens(F.col("texts"), stop_words).alias("tokens"),
                         F.array_join("headers", ". ").alias("h"),
                         F.array_join("styled_texts", ". ").alias("s"))
    tags = keyword_tags(docs, threshold, headers="h", styled="s").withColumnRenamed("doc_id", "page_id")
    return tags, fields


def entity_tags_of(fields: DataFrame, gazetteer: DataFrame | None = None) -> DataFrame:
    """``(page_id, label_rank, title, entity_rank, entity)``: entity tags of the pages' raw text."""
    docs = fields.select(F.col("page_id").alias("doc_id"), F.col("texts").alias("text"))
    gaz = gazetteer if gazetteer is not None else default_gazetteer(fields.sparkSession)
    return entity_tags(entity_spans(entity_words(docs), gaz, docs)).withColumnRenamed("doc_id", "page_id")
