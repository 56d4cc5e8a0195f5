"""Text features: tokens, term and document frequency, TF-IDF family, n-grams.

Long form everywhere: ``(doc_id, term, tf, weight)`` rows, never a dense
document-term matrix. Per-document steps run inside the document's row;
corpus steps are one aggregation by term and one join back on term, which
AQE turns into a broadcast when the vocabulary side is measured small.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagweave.functions.text import (DEFAULT_STOP_WORDS, clean_tokens, explode_structs,
                                     with_term_counts, word_ngrams)
from tagweave.operators.vectors import TermBlocks
from tagweave.session import write_shared


def prepare_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                      stop_words: Iterable[str] | None = DEFAULT_STOP_WORDS,
                      lemmas=None, keep: Iterable[str] = ()) -> DataFrame:
    """Clean each document into ``(doc_id, tokens array<string>, *keep)``.

    ``lemmas`` is an optional :class:`tagweave.operators.lemma.Lemmatizer`;
    without it the step is one projection (no shuffle).
    """
    out = docs.select(F.col(id_col).alias("doc_id"),
                      clean_tokens(F.col(text_col), stop_words).alias("tokens"), *keep)
    if lemmas is not None:
        out = lemmas.apply(out)
    return out


def term_frequencies(tokens: DataFrame, min_len: int = 1) -> DataFrame:
    """A1: ``(doc_id, term, tf)``. Counted inside each row, then exploded: no shuffle."""
    tf = with_term_counts(tokens.select("doc_id", "tokens"), "tokens", "tf_arr")
    rows = explode_structs(tf, "tf_arr", ["doc_id"])
    if min_len > 1:
        rows = rows.where(F.length("term") >= min_len)
    return rows


def bag_table(tokens: DataFrame) -> DataFrame:
    """``(doc_id, tf_arr)``, written once to the shared folder: texts are read and tokenised in this one pass,
    and document frequencies, weights and counts are read from the bags."""
    bags = with_term_counts(tokens.select("doc_id", "tokens"), "tokens", "tf_arr").select("doc_id", "tf_arr")
    return bags.sparkSession.read.schema(bags.schema).parquet(write_shared(bags, "bags"))


def document_frequency(tf: DataFrame) -> DataFrame:
    """A2: ``(term, df)``. Map-side partial count, one shuffle of distinct terms."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def doc_count(docs: DataFrame):
    """Number of documents as a scalar-subquery column (evaluated once, no join)."""
    return docs.select(F.count(F.lit(1))).scalar()


def idf_table(tf: DataFrame, n_docs, max_df: float | int = 1.0, min_df: float | int = 1,
              max_features: int | None = None) -> DataFrame:
    """``(term, df, idf)`` with smoothed idf = ln((1+n)/(1+df)) + 1.

    ``max_df`` / ``min_df``: a float is a share of the documents, an int a
    count. ``max_features`` keeps the terms with the largest corpus count
    (ties: term ascending), after the df filters.
    """
    stats = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    n = n_docs
    hi = F.lit(max_df) * n if isinstance(max_df, float) else F.lit(max_df)
    lo = F.lit(min_df) * n if isinstance(min_df, float) else F.lit(min_df)
    if not (isinstance(max_df, float) and max_df >= 1.0):
        stats = stats.where(F.col("df") <= hi)
    if not (not isinstance(min_df, float) and min_df <= 1):
        stats = stats.where(F.col("df") >= lo)
    if max_features is not None:
        # A global top-N is the feature here: Spark plans it as a per-partition
        # top-N followed by a merge of N rows per partition (TakeOrderedAndProject).
        stats = stats.orderBy(F.col("cf").desc(), F.col("term")).limit(max_features)
    return stats.select("term", "df", (F.log((F.lit(1) + n) / (F.col("df") + 1)) + 1).alias("idf"))


def l2_normalize(weights: DataFrame, value: str = "weight", by: str = "doc_id") -> DataFrame:
    """Divide ``value`` by the L2 norm of its document (one shuffle by ``by``); zero rows stay zero."""
    w = Window.partitionBy(by)
    norm = F.sqrt(F.sum(F.col(value) * F.col(value)).over(w))
    return weights.withColumn(value, F.when(norm > 0, F.col(value) / norm).otherwise(F.lit(0.0)))


def tfidf(tokens: DataFrame, max_df: float | int = 1.0, min_df: float | int = 1,
          max_features: int | None = None, ngram_range: tuple[int, int] = (1, 1),
          return_idf: bool = False):
    """Corpus TF-IDF with the reference library's defaults.

    Terms are runs of at least two word characters (the cleaned tokens), n is
    every input document (empty ones too), weights are L2-normalised per
    document. Returns ``(doc_id, term, tf, weight)``; with ``return_idf`` also
    the fitted ``(term, df, idf)`` table, which :func:`apply_idf` reuses.
    """
    src = tokens
    if ngram_range != (1, 1):
        # the filtered array is its own column so the n-gram lambdas read it, not recompute it
        src = (tokens.select("doc_id", F.filter("tokens", lambda t: F.length(t) >= 2).alias("tokens"))
                     .select("doc_id", word_ngrams(F.col("tokens"), *ngram_range).alias("tokens")))
    bags = bag_table(src)
    tf = explode_structs(bags, "tf_arr", ["doc_id"]).where(F.length("term") >= 2)
    idf = idf_table(tf, doc_count(bags), max_df, min_df, max_features)
    w = tf.join(idf, "term").select("doc_id", "term", "tf", (F.col("tf") * F.col("idf")).alias("weight"))
    w = l2_normalize(w)
    return (w, idf) if return_idf else w


def tfidf_blocks(tokens: DataFrame) -> TermBlocks:
    """A3 for operators that go over all documents in every round: the weights of :func:`tfidf`, with documents in
    blocks and idf as the factor of a term, so that no row of a document and term is moved."""
    bags = with_term_counts(tokens.select("doc_id", "tokens"), "tokens", "tf_arr").select(
        "doc_id", F.filter("tf_arr", lambda x: F.length(x["term"]) >= 2).alias("e"))
    bags = bags.select("doc_id", F.col("e.term").alias("t"), F.col("e.tf").cast("array<double>").alias("x"))
    bags = bags.sparkSession.read.schema(bags.schema).parquet(write_shared(bags, "bags"))
    df = document_frequency(bags.select(F.explode("t").alias("term")))
    idf = df.select("term", (F.log((F.lit(1) + doc_count(bags)) / (F.col("df") + 1)) + 1).alias("f"))
    return TermBlocks(bags, tokens, idf, unit=True)


def apply_idf(tokens: DataFrame, idf: DataFrame) -> DataFrame:
    """Weight new documents with a fitted ``(term, idf)`` table; unseen terms drop."""
    tf = term_frequencies(tokens, min_len=2)
    w = tf.join(idf.select("term", "idf"), "term").select(
        "doc_id", "term", "tf", (F.col("tf") * F.col("idf")).alias("weight"))
    return l2_normalize(w)


def top_terms(weights: DataFrame, n: int, value: str = "weight", by: str = "doc_id") -> DataFrame:
    """The ``n`` largest values per document (ties: term ascending), with ``rank``."""
    w = Window.partitionBy(by).orderBy(F.col(value).desc(), F.col("term"))
    return weights.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def _with_doc_stats(tokens: DataFrame) -> DataFrame:
    """tf array plus N (tokens), V (distinct terms) and the norm of 2+ character terms."""
    df = with_term_counts(tokens, "tokens", "tf_arr")
    return (df.withColumn("n_tok", F.size("tokens"))
              .withColumn("n_terms", F.size("tf_arr"))
              .withColumn("norm", F.sqrt(F.aggregate(
                  "tf_arr", F.lit(0).cast("long"),
                  lambda acc, x: F.when(F.length(x["term"]) >= 2, acc + x["tf"].cast("long") * x["tf"]).otherwise(acc)))))


def single_doc_tfidf(tokens: DataFrame) -> DataFrame:
    """TF-IDF of a document fitted on itself: idf = 1, score = tf / ||tf||2.

    ``(doc_id, term, tf, score)``; computed inside the row, no shuffle.
    """
    df = _with_doc_stats(tokens)
    return (explode_structs(df, "tf_arr", ["doc_id", "norm"])
              .where(F.length("term") >= 2)
              .select("doc_id", "term", "tf", (F.col("tf") / F.col("norm")).alias("score")))


def one_topic_lda(tokens: DataFrame, top_n: int = 10) -> DataFrame:
    """One-topic LDA fitted on one document, in closed form.

    One topic, prior 1 and one online pass give p(w) = (c_w + 1) / (N + V), a
    Laplace-smoothed unigram. Top ``top_n`` by count (ties: term ascending).
    ``(doc_id, rank, term, prob)``; inside the row, no shuffle.
    """
    df = _with_doc_stats(tokens)
    ranked = F.slice(F.sort_array(F.transform(
        "tf_arr", lambda x: F.struct((-x["tf"]).alias("k"), x["term"].alias("term"), x["tf"].alias("tf")))),
        1, top_n)
    df = df.withColumn("_top", ranked)
    return (explode_structs(df, "_top", ["doc_id", "n_tok", "n_terms"], pos="pos")
              .select("doc_id", (F.col("pos") + 1).alias("rank"), "term",
                      ((F.col("tf") + 1) / (F.col("n_tok") + F.col("n_terms"))).alias("prob")))


def ngram_counts(tokens: DataFrame, lo: int = 1, hi: int = 2) -> DataFrame:
    """``(doc_id, term, tf)`` over word n-grams, n in [lo, hi]."""
    grams = tokens.select("doc_id", word_ngrams(F.col("tokens"), lo, hi).alias("tokens"))
    return term_frequencies(grams)


def top_ngrams(tokens: DataFrame, n: int, lo: int = 1, hi: int = 2) -> DataFrame:
    """A5 per document: ``(doc_id, term, tf, rank)``, the ``n`` most frequent word n-grams (ties: term ascending).

    Each row keeps its own ``n`` first; only these are ranked, by document, in case an id has several rows."""
    grams = tokens.select("doc_id", word_ngrams(F.col("tokens"), lo, hi).alias("tokens"))
    bags = with_term_counts(grams, "tokens", "tf_arr").select("doc_id", "tf_arr")
    least = F.coalesce(F.get(F.sort_array(F.transform("tf_arr", lambda x: x["tf"]), asc=False), n - 1), F.lit(0))
    # only the counts that reach the n-th largest are sorted as structs; that is one element, so it is computed once a row
    some = F.get(F.transform(F.array(least), lambda t: F.filter("tf_arr", lambda x: x["tf"] >= t)), 0)
    first = F.slice(F.sort_array(F.transform(some, lambda x: F.struct((-x["tf"]).alias("k"), x["term"].alias("term"),
                                                                       x["tf"].alias("tf")))), 1, n)
    rows = explode_structs(bags.select("doc_id", first.alias("_top")), "_top", ["doc_id"]).drop("k")
    return top_terms(rows, n, value="tf")
