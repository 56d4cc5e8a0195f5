"""J7 lemma lookup without a dictionary library.

A word's candidates are the word itself and the noun suffix rewrites below
(or, for listed irregular forms, their exception lemmas); a candidate counts
when it is in the ``lexicon`` table; the shortest accepted candidate wins
(ties: the word, then rule order); otherwise the word stays. Lemmas are found
once per distinct term. The terms they change are joined with the distinct
terms of each document and put into its token list inside the row, so no
token occurrence is exploded, shuffled or sorted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.functions.text import explode_structs

# Noun suffix rewrites (suffix, replacement), in rule order.
NOUN_RULES = (("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"),
              ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"))


class Lemmatizer:
    """``lexicon(lemma)`` and optional ``exceptions(form, lemma)`` tables."""

    def __init__(self, lexicon: DataFrame, exceptions: DataFrame | None = None):
        self.lexicon = lexicon.select(F.col("lemma").alias("cand")).distinct()
        self.exceptions = exceptions

    def mapping(self, terms: DataFrame) -> DataFrame:
        """``(term, lemma)`` for the distinct ``term`` values given."""
        t = terms.select("term").distinct()
        rules = F.array(*[F.struct(F.lit(s).alias("suf"), F.lit(r).alias("rep"), F.lit(i + 1).alias("prio"))
                          for i, (s, r) in enumerate(NOUN_RULES)])
        by_rule = t.select("term", F.filter(F.transform(rules, lambda r: F.when(
            F.endswith("term", r["suf"]),
            F.struct(F.concat(F.substr(F.col("term"), F.lit(1), F.length("term") - F.length(r["suf"])),
                              r["rep"]).alias("cand"), r["prio"].alias("prio")))),
            lambda x: x.isNotNull()).alias("_c"))
        cands = explode_structs(by_rule, "_c", ["term"])
        if self.exceptions is not None:
            exc = self.exceptions.select(F.col("form").alias("term"), F.col("lemma").alias("cand"),
                                         F.lit(1).alias("prio"))
            cands = cands.join(exc.select("term").distinct(), "term", "left_anti").unionByName(
                exc.join(t, "term", "left_semi"))
        cands = cands.unionByName(t.select("term", F.col("term").alias("cand"), F.lit(0).alias("prio")))
        ok = cands.join(self.lexicon, "cand", "left_semi")
        best = ok.groupBy("term").agg(F.min_by("cand", F.struct(F.length("cand"), F.col("prio"))).alias("lemma"))
        return t.join(best, "term", "left").select("term", F.coalesce("lemma", "term").alias("lemma"))

    def apply(self, tokens: DataFrame) -> DataFrame:
        """``tokens`` with every token replaced by its lemma, order kept; null lists become empty.

        ``tokens`` is read twice: store it if it is costly.
        """
        terms = tokens.select("doc_id", F.explode(F.array_distinct("tokens")).alias("term"))
        changed = self.mapping(terms).where(F.col("lemma") != F.col("term"))
        own = (terms.join(changed, "term").groupBy("doc_id")
                    .agg(F.collect_set(F.struct("term", "lemma")).alias("_m"))
                    .select(F.col("doc_id").alias("_d"), F.transform("_m", lambda x: x["term"]).alias("_from"),
                            F.transform("_m", lambda x: x["lemma"]).alias("_to")))
        none = F.array().cast("array<string>")
        src = tokens.join(own, F.col("doc_id").eqNullSafe(F.col("_d")), "left").drop("_d").withColumns(
            {c: F.coalesce(c, none) for c in ("tokens", "_from", "_to")})
        extra = [c for c in tokens.columns if c not in ("doc_id", "tokens")]
        src = src.select("doc_id", "tokens", *extra, "_from", "_to")

        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays(
                    [replace_terms(b["tokens"], b["_from"], b["_to"]) if c == "tokens" else b[c] for c in b.schema.names[:-2]],
                    names=b.schema.names[:-2])

        return src.mapInArrow(run, src.drop("_from", "_to").schema)


def replace_terms(tokens: pa.ListArray, old: pa.ListArray, new: pa.ListArray) -> pa.ListArray:
    """Each row's ``tokens`` with the row's ``old`` terms replaced by its ``new`` ones (parallel lists, no nulls)."""
    words, olds, news = tokens.flatten(), old.flatten(), new.flatten()
    length = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = pa.array(np.concatenate(([0], np.cumsum(length))), pa.int32())
    known = olds.unique()
    if len(known):
        row = lambda a: pc.list_parent_indices(a).to_numpy().astype(np.int64)
        code = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy().astype(np.int64)
        key = row(old) * len(known) + pc.index_in(olds, value_set=known).to_numpy().astype(np.int64)
        order = np.argsort(key)
        at = np.flatnonzero(code >= 0)
        want = row(tokens)[at] * len(known) + code[at]
        place = np.minimum(np.searchsorted(key[order], want), len(key) - 1)
        hit = key[order][place] == want
        take = np.arange(len(words), dtype=np.int64)
        take[at[hit]] = len(words) + order[place[hit]]
        words = pa.concat_arrays([words, news]).take(pa.array(take))
    return pa.ListArray.from_arrays(offsets, words)


def corpus_lexicon(tokens: DataFrame, min_df: int = 2) -> DataFrame:
    """Default lexicon: terms of the corpus found in at least ``min_df`` documents."""
    t = tokens.select("doc_id", F.explode(F.array_distinct("tokens")).alias("term")).distinct()
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df) \
            .select(F.col("term").alias("lemma"))
