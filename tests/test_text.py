import pytest
from pyspark.sql import functions as F

from tagweave.functions import text as T

STOP = ["the", "and", "for", "now", "are", "button", "submit", "menu", "login"]


@pytest.mark.parametrize("raw,cleaned", [
    ("Don't click <b>HTTP://x.y/z</b> now2 {html}foo_bar", "dont click foobar"),
    ("see http and xhttp://q.r end", "see http end"),
    ("a<br\nclass=x>bee cee", "abr classxbee cee"),
    ("Submit the MENU v2alpha e.g. été", "valpha été"),
    ("line1\r\nline2 café-bar", "line line cafébar"),
    ("", ""),
    (None, ""),
])
def test_clean_text_goldens(spark, raw, cleaned):
    df = spark.createDataFrame([(raw,)], "text string")
    assert df.select(T.clean_text(F.col("text"), STOP)).first()[0] == cleaned


def test_term_counts_and_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "a", "c"],), ([],)], "tokens array<string>")
    rows = T.with_term_counts(df, "tokens", "tc").collect()
    assert [(r.term, r.tf) for r in rows[0].tc] == [("a", 2), ("b", 1), ("c", 1)]
    assert rows[1].tc == []
    ng = df.select(T.word_ngrams(F.col("tokens"), 1, 2).alias("g")).collect()
    assert ng[0].g == ["a", "b", "a", "c", "a b", "b a", "a c"]
    assert ng[1].g == []


def test_escape_and_capitalize(spark):
    r = spark.range(1).select(T.escape_html(F.lit("a<b>&\"c'")).alias("e"),
                              T.capitalize(F.lit("WORK_OF_ART")).alias("c")).first()
    assert r.e == "a&lt;b&gt;&amp;&quot;c&#039;"
    assert r.c == "Work_of_art"


def test_default_stop_list_shape():
    assert len(T.ENGLISH_STOP_WORDS) == 179
    assert T.DEFAULT_STOP_WORDS[-4:] == ("button", "submit", "menu", "login")
