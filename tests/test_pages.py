from pyspark.sql import functions as F

from conftest import SF001
from tagweave.functions.html import page_fields
from tagweave.sources import pages as PG
from tagweave.sources.tables import read_table


def test_page_fields_on_test_pages(spark):
    f = PG.extract_page_fields(read_table(spark, SF001, "pages")).collect()
    assert len(f) == 50
    for r in f:
        assert r.title and len(r.headers) == 1 and 1 <= len(r.styled_texts) <= 11
        assert "track(" not in r.texts and "margin" not in r.texts   # script / style skipped
        assert r.headers[0] in r.texts


def test_page_fields_unclosed_inline_and_blocks():
    title, texts, heads, styled = page_fields(
        "<html><head><title>T &amp; U</title></head><body><h1>Head</h1><p><b>bold<br><p>next</p>"
        "<div>tail <em>em</em></div></body></html>")
    assert title == "T & U"
    assert heads == ["Head"]
    assert styled == ["bold", "em"]      # the unclosed <b> ends with its paragraph
    assert texts.split("\n")[0] == "Head" and "next" in texts and "tail em" in texts


def test_url_filter_and_link_info(spark):
    pages = spark.createDataFrame([
        (1, "chrome://x", "<title>a</title>"), (2, "devtools://x", ""), (3, "browser://x", ""),
        (4, "chrome-extension://x", ""), (5, "https://chrome.example", "<html><head><title>A &lt;b&gt;</title>"
                                                                     "<script>var s='<p>';</script></head><body><p>x</p></body></html>")],
        "page_id long, url string, html string")
    kept = [r.page_id for r in PG.drop_internal_urls(pages).collect()]
    assert kept == [5]
    links = spark.createDataFrame([("https://chrome.example",), ("https://chrome.example",), ("https://nope",)], "url string")
    info = {r.url: (r.title, r.tags) for r in PG.link_info(links, pages).collect()}
    assert info["https://chrome.example"] == ("A <b>", ["html", "head", "title", "script", "body", "p"])
    assert info["https://nope"] == (None, None)
    assert len(info) == 2


def test_deep_pages():
    from tagweave.functions.html import outline, plain_text
    deep = "<body>" + "<div>" * 5000 + "x<b>y" + "</div>" * 5000 + "<p>z"
    title, texts, _, styled = page_fields(deep)
    assert title is None and texts.split() == ["xy", "z"] and styled == ["y"]
    assert plain_text(deep) == "xyz" and outline(deep)[1].count("div") == 5000
    flat = "<p>" * 20_000 + "<li>" * 20_000 + "</i>" * 20_000    # no scan of the open elements per tag
    assert len(outline(flat)[1]) == 40_000 and page_fields(flat)[1] == ""


def test_titles_and_tags_agree(spark):
    rows = [(1, "u1", "<title>A &mdash; B &eacute; &#8211; &#x27;</title><p title='a <b> c'>x</p><!-- <u> --><br/>"),
            (2, "u1", "<title>newer</title>"), (3, "u2", "<title></title><a href=\"<i>\">"), (4, "u3", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    fields = {r.page_id: r.title for r in PG.extract_page_fields(pages).collect()}
    out = {r.page_id: (r.title, r.tags) for r in PG.page_outline(pages, "page_id").collect()}
    assert out[1] == ("A \u2014 B \u00e9 \u2013 '", ["title", "p", "br"]) and out[3] == (None, ["title", "a"])
    assert {k: v[0] for k, v in out.items()} == fields
    links = spark.createDataFrame([("u1",), ("u1",), ("u9",)], "url string")
    info = {r.url: r.title for r in PG.link_info(links, pages).collect()}
    assert info == {"u1": "newer", "u9": None}    # one row a url, the later crawl
