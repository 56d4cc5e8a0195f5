"""A10 keyword tags: single-document TF-IDF and one-topic LDA scores, boosted.

Everything is computed inside the document's row with higher-order array
functions and native ``sort_array``; the only row multiplication is the
final ``posexplode`` of the kept tags. There is no shuffle, so the operator
scales with the number of executors and is unaffected by hot terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.functions.text import explode_structs
from tagweave.operators.features import _with_doc_stats

# Boosts of terms found in headings and in styled text.
HEADER_BOOST = 1.5
STYLED_BOOST = 1.2
# End of fixed values.


def _boost(term: Column, headers: Column, styled: Column) -> Column:
    """1.5 when the term is a substring of the headers text, else 1.2 for styled text.

    Case-sensitive on purpose: terms are lower case, page text is not (Q7).
    """
    return (F.when(F.coalesce(F.contains(headers, term), F.lit(False)), F.lit(HEADER_BOOST))
             .when(F.coalesce(F.contains(styled, term), F.lit(False)), F.lit(STYLED_BOOST))
             .otherwise(F.lit(1.0)))


def _once(value: Column, of) -> Column:
    """``of(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), of), 0)


def keyword_tags(tokens: DataFrame, threshold: float = 0.2, top_n: int = 10,
                 headers: str | None = None, styled: str | None = None) -> DataFrame:
    """Keyword tags per document: ``(doc_id, rank, tag, score)``.

    ``tokens``: ``(doc_id, tokens array<string>)`` plus, optionally, string
    columns named by ``headers`` / ``styled`` (texts joined by ". ").

    a(w) = c / sqrt(sum c^2) over 2+ character terms; b(w) = (c+1)/(N+V).
    Candidates: a > threshold, or among the ``top_n`` of b (ties: term).
    Each candidate keeps a*boost and (top-n only) b*boost when above the
    threshold. Order: ascending by the smaller kept score, a-entry before
    b-entry, a-entries by term, b-entries by their top-n rank; the reported
    score is the larger kept score.
    """
    h = F.col(headers) if headers else F.lit(None).cast("string")
    s = F.col(styled) if styled else F.lit(None).cast("string")
    thr = F.lit(float(threshold))
    df = _with_doc_stats(tokens.select("doc_id", "tokens", h.alias("_h"), s.alias("_s")))
    # few terms can be tags: the top_n of b, and those whose count may lift a over the threshold; only these are scored.
    # Bounds and ranks are put into arrays of one element, so that they are computed once a row and not for every term.
    count = F.get(F.sort_array(F.transform("tf_arr", lambda x: x["tf"]), asc=False), top_n - 1)
    some = _once(F.coalesce(count, F.lit(0)), lambda t: F.filter("tf_arr", lambda x: x["tf"] >= t))
    first = F.slice(F.sort_array(F.transform(some, lambda x: F.struct((-x["tf"]).alias("k"), x["term"].alias("term"),
                                                                      x["tf"].alias("tf")))), 1, top_n)
    df = df.withColumn("_top", first)
    often = _once(F.floor(thr * F.col("norm")), lambda t: F.filter("tf_arr", lambda x: x["tf"] >= t))
    names = F.transform("_top", lambda x: x["term"])
    rest = _once(names, lambda top: F.filter(often, lambda x: ~F.array_contains(top, x["term"])))
    asked = F.concat(F.transform("_top", lambda x, i: F.struct(x["term"].alias("term"), x["tf"].alias("tf"), (i + 1).alias("brank"))),
                     F.transform(rest, lambda x: F.struct(x["term"].alias("term"), x["tf"].alias("tf"), F.lit(0).alias("brank"))))

    def scored(x):
        a = F.when(F.length(x["term"]) >= 2, x["tf"] / F.col("norm"))
        b = F.when(x["brank"] > 0, (x["tf"] + 1) / (F.col("n_tok") + F.col("n_terms")))
        return F.struct(x["term"].alias("term"), x["brank"].alias("brank"), a.alias("a"), b.alias("b"),
                        _boost(x["term"], F.col("_h"), F.col("_s")).alias("boost"))

    def kept(x):
        a = F.when(((x["a"] > thr) | (x["brank"] > 0)) & (x["a"] * x["boost"] > thr), x["a"] * x["boost"])
        b = F.when(x["b"] * x["boost"] > thr, x["b"] * x["boost"])
        return F.struct(x["term"].alias("term"), x["brank"].alias("brank"), a.alias("a"), b.alias("b"))

    def entry(x):
        kind = F.when(x["a"].isNotNull() & (x["b"].isNull() | (x["a"] <= x["b"])), F.lit(0)).otherwise(F.lit(1))
        return F.struct(F.least(x["a"], x["b"]).alias("lo"), kind.alias("kind"),
                        F.when(kind == 1, x["brank"]).otherwise(F.lit(0)).alias("brank"),
                        x["term"].alias("tag"), F.greatest(x["a"], x["b"]).alias("score"))

    some = F.filter(F.transform(F.transform(asked, scored), kept), lambda x: x["a"].isNotNull() | x["b"].isNotNull())
    df = df.withColumn("_kept", F.sort_array(F.transform(some, entry)))
    return (explode_structs(df, "_kept", ["doc_id"], pos="pos")
              .select("doc_id", (F.col("pos") + 1).alias("rank"), "tag", "score"))
