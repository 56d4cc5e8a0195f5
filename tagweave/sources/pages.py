"""Page sources: S2 page fields, S3 body text, S4 link info, S5 plain text, F1 URL filter.

Parsing HTML is the one job Spark has no built-in for, so the stdlib parser
runs inside ``mapInPandas`` (Arrow batches, one pass per partition, no
shuffle). One reader gives titles everywhere, so S2, S4 and S8 agree.
"""

from __future__ import annotations

from typing import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave import schemas
from tagweave.functions.text import INTERNAL_URL_PREFIXES


def _fields_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from tagweave.functions.html import page_fields
    for pdf in batches:
        rows = [page_fields(h) for h in pdf["html"].fillna("")]
        yield pd.DataFrame({
            "page_id": pdf["page_id"], "url": pdf["url"],
            "title": [r[0] for r in rows], "texts": [r[1] for r in rows],
            "headers": [r[2] for r in rows], "styled_texts": [r[3] for r in rows],
        })


def extract_page_fields(pages: DataFrame) -> DataFrame:
    """``(page_id, url, title, texts, headers, styled_texts)``, one row per page."""
    return pages.select("page_id", "url", "html").mapInPandas(_fields_batches, schemas.PAGE_FIELDS)


def page_content(pages: DataFrame) -> DataFrame:
    """S3: body text only."""
    return extract_page_fields(pages).select("page_id", F.col("texts").alias("content"))


def _plain_batches(batches):
    from tagweave.functions.html import plain_text
    for pdf in batches:
        yield pd.DataFrame({"page_id": pdf["page_id"], "text": [plain_text(h) for h in pdf["html"].fillna("")]})


def html_to_text(pages: DataFrame) -> DataFrame:
    """All text of the page joined without a separator."""
    return pages.select("page_id", "html").mapInPandas(_plain_batches, "page_id long, text string")


def drop_internal_urls(pages: DataFrame, prefixes: Iterable[str] = INTERNAL_URL_PREFIXES,
                       url_col: str = "url") -> DataFrame:
    """drop browser-internal pages. A plain predicate, pushed into the scan."""
    cond = F.lit(True)
    for p in prefixes:
        cond = cond & ~F.col(url_col).startswith(p)
    return pages.where(cond)


def _outline_batches(batches):
    from tagweave.functions.html import outline
    for pdf in batches:
        rows = [outline(h) for h in pdf["html"].fillna("")]
        yield pdf.drop(columns="html").assign(title=[r[0] for r in rows], tags=[r[1] for r in rows])


def page_outline(pages: DataFrame, *keys: str) -> DataFrame:
    """``(keys..., title, tags)``: title and start-tag names of each page, by the HTML reader.

    Character references of any kind are decoded, and ``<`` in attributes, comments, scripts or styles opens
    no tag. Null when a page has no title or an empty one.
    """
    src = pages.select(*keys, "html")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "html")
    return src.mapInPandas(_outline_batches, f"{schema}, title string, tags array<string>")


def link_info(links: DataFrame, pages: DataFrame) -> DataFrame:
    """``(url, title, tags)`` per distinct link; unknown links get a null title and no tags.

    Pages come from a stored crawl table. Only linked pages are parsed (semi join before the reader). The
    reply is keyed by link, so of several crawls of a url the one with the largest page_id counts. The join
    is a left join: one missing page does not fail the batch.
    """
    wanted = links.select("url").distinct()
    newest = (pages.join(wanted, "url", "left_semi")
                   .groupBy("url").agg(F.max_by("html", "page_id").alias("html")))
    return wanted.join(page_outline(newest, "url"), "url", "left")
