"""A15 TextRank and A16 combination counts, per document.

Both operators are local to one document: its word graph or its token
positions never interact with other documents. So Spark builds the
per-document inputs in the JVM (tokens, keep mask, distinct undirected
edges as arrays inside the row) and a small numpy helper in ``mapInPandas``
does the per-row arithmetic. There is no shuffle and no driver loop; a
DataFrame power iteration would instead shuffle every edge of the corpus
once per round.
"""

from __future__ import annotations

from typing import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions.text import DEFAULT_STOP_WORDS, PY_SPACE_CLASS, WORD_CLASS

# a token is a run of word characters or one other non-blank character
RAW_TOKEN = "[" + WORD_CLASS + "]+|[^" + PY_SPACE_CLASS + WORD_CLASS + "]"


def raw_tokens(docs: DataFrame, text_col: str = "text",
               stop_words: Iterable[str] = DEFAULT_STOP_WORDS) -> DataFrame:
    """``(doc_id, rt, keep)``: word and punctuation tokens in order; keep = alphabetic, not a stop word."""
    stop = tuple(stop_words)
    return (docs.select("doc_id", F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")),
                                                       F.lit(RAW_TOKEN), 0).alias("rt"))
                .withColumn("keep", F.transform("rt", lambda t: t.rlike("^\\p{L}+$")
                                                & ~F.lower(t).isin(*stop))))


def word_graph(tokens: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, *keep, ea, eb)``: distinct undirected edges between adjacent kept tokens (ea <= eb)."""
    n = F.size("rt")
    edges = F.filter(
        F.transform(F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")),
                    lambda i: F.struct(F.least(F.get("rt", i - 1), F.get("rt", i)).alias("a"),
                                       F.greatest(F.get("rt", i - 1), F.get("rt", i)).alias("b"),
                                       (F.get("keep", i - 1) & F.get("keep", i)).alias("k"))),
        lambda e: e["k"])
    # kept tokens are letters only, so a blank parts the two; array_distinct hashes strings, but compares every two structs
    g = tokens.withColumn("_e", F.array_distinct(F.transform(edges, lambda e: F.concat(e["a"], F.lit(" "), e["b"]))))
    return g.select("doc_id", *keep, F.transform("_e", lambda e: F.substring_index(e, " ", 1)).alias("ea"),
                    F.transform("_e", lambda e: F.substring_index(e, " ", -1)).alias("eb"))


def pagerank_local(ea, eb, alpha: float = 0.85, max_iter: int = 100, tol: float | None = 1e-6):
    """PageRank of one undirected graph given as edge lists; returns (nodes, scores).

    Each undirected edge is followed both ways, a self-loop once; no node is
    dangling. Uniform start and teleport. Stops when the L1 change is below
    n * tol (``tol=None``: exactly ``max_iter`` rounds); scores that have not
    converged after ``max_iter`` rounds raise.
    """
    if len(ea) == 0:
        return np.array([], dtype=object), np.array([])
    nodes, inv = np.unique(np.concatenate([np.asarray(ea, dtype=object), np.asarray(eb, dtype=object)]),
                           return_inverse=True)
    m = len(ea)
    a, b = inv[:m], inv[m:]
    loop = a == b
    src = np.concatenate([a, b[~loop]])
    dst = np.concatenate([b, a[~loop]])
    n = len(nodes)
    outdeg = np.bincount(src, minlength=n).astype(float)
    x = np.full(n, 1.0 / n)
    for _ in range(max_iter):
        last = x
        x = alpha * np.bincount(dst, weights=last[src] / outdeg[src], minlength=n) + (1.0 - alpha) / n
        if tol is not None and np.abs(x - last).sum() < n * tol:
            return nodes, x
    if tol is not None:
        raise ArithmeticError(f"PageRank has not converged to {tol} in {max_iter} rounds")
    return nodes, x


def pagerank_batch(graph, ea, eb, alpha: float = 0.85, max_iter: int = 100, tol: float | None = 1e-6):
    """:func:`pagerank_local` of many graphs at once: edge i belongs to graph ``graph[i]`` (sorted).

    Returns ``(graph of each node, nodes, scores)``. A graph that has converged keeps its scores while the
    others go on, so its result does not depend on its neighbours in the batch.
    """
    if len(ea) == 0:
        return np.zeros(0, dtype=np.int64), np.array([], dtype=object), np.array([])
    m = len(ea)
    names, inv = np.unique(np.concatenate([np.asarray(ea, dtype=object), np.asarray(eb, dtype=object)]), return_inverse=True)
    key = np.concatenate([graph, graph]) * len(names) + inv
    ids, at = np.unique(key, return_inverse=True)
    owner, nodes = ids // len(names), names[ids % len(names)]
    a, b = at[:m], at[m:]
    loop = a == b
    src, dst = np.concatenate([a, b[~loop]]), np.concatenate([b, a[~loop]])
    n, g = len(ids), int(graph[-1]) + 1
    size = np.bincount(owner, minlength=g).astype(float)
    out = np.bincount(src, minlength=n).astype(float)
    rest = (1.0 - alpha) / size[owner]
    x, done = 1.0 / size[owner], size == 0
    for _ in range(max_iter):
        new = alpha * np.bincount(dst, weights=(x / out)[src], minlength=n) + rest
        new = np.where(done[owner], x, new)
        if tol is not None:
            done |= np.bincount(owner, weights=np.abs(new - x), minlength=g) < size * tol
        x = new
        if done.all():
            return owner, nodes, x
    if tol is not None:
        raise ArithmeticError(f"PageRank has not converged to {tol} in {max_iter} rounds")
    return owner, nodes, x


def textrank(docs: DataFrame, top_n: int = 10, alpha: float = 0.85, max_iter: int = 100,
             tol: float | None = 1e-6, text_col: str = "text",
             stop_words: Iterable[str] = DEFAULT_STOP_WORDS, rank_digits: int | None = None,
             tokens: DataFrame | None = None) -> DataFrame:
    """``(doc_id, rank, term, score)``, the ``top_n`` PageRank words of each document.

    Graph: adjacent tokens (positions i, i+1) that are both alphabetic and not
    stop words are linked (Q11: neighbour = adjacent position). Ties: term
    ascending; ``rank_digits`` rounds scores before ranking so that equal
    scores computed in different summation orders tie exactly. ``tokens``: the
    output of :func:`raw_tokens` when the caller already has it.
    """
    g = word_graph(tokens if tokens is not None else raw_tokens(docs, text_col, stop_words))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo:lo + 256]
                count = part["ea"].map(len).to_numpy()
                graph = np.repeat(np.arange(len(part)), count)
                ea, eb = ([t for edges in part[c] for t in edges] for c in ("ea", "eb"))
                owner, nodes, x = pagerank_batch(graph, ea, eb, alpha, max_iter, tol)
                key = np.round(x, rank_digits) if rank_digits is not None else x
                # by document, score falling, then term: nodes are in term order within a document
                order = np.lexsort((np.arange(len(x)), -key, owner))
                rank = np.arange(len(x)) - np.searchsorted(owner[order], owner[order])
                top = order[rank < top_n]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[owner[top]],
                                    "rank": (rank[rank < top_n] + 1).astype("int32"),
                                    "term": nodes[top], "score": x[top]})

    return g.mapInPandas(run, "doc_id long, rank int, term string, score double")


def textrank_rows(rows: DataFrame, top_n: int = 10, alpha: float = 0.85, max_iter: int = 100, tol: float | None = 1e-6,
                  rank_digits: int | None = None) -> DataFrame:
    """A15 inside the row: ``rows`` with the edges ``ea`` and ``eb`` replaced by ``tr``, the ``top_n`` terms of
    :func:`textrank` in their order, so that a document's other columns need no second pass over the texts."""
    others = [c for c in rows.columns if c not in ("ea", "eb")]
    schema = T.StructType([rows.schema[c] for c in others] + [T.StructField("tr", T.ArrayType(T.StringType()))])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                graph = np.repeat(np.arange(part.num_rows), part.column("ea").value_lengths().to_numpy(zero_copy_only=False))
                ea, eb = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("ea", "eb"))
                owner, nodes, x = pagerank_batch(graph, ea, eb, alpha, max_iter, tol)
                key = np.round(x, rank_digits) if rank_digits is not None else x
                order = np.lexsort((np.arange(len(x)), -key, owner))
                top = order[np.arange(len(x)) - np.searchsorted(owner[order], owner[order]) < top_n]
                ends = np.append(0, np.cumsum(np.bincount(owner[top], minlength=part.num_rows))).astype(np.int32)
                tr = pa.ListArray.from_arrays(pa.array(ends), pa.array(nodes[top], pa.string()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), tr], names=[*others, "tr"])

    return rows.mapInArrow(run, schema)


# ---------------------------------------------------------------------------
# A16


PAIR_CELLS = 1 << 13   # positions times first terms counted at once


def _top_combinations(tokens: list, k: int):
    """Top ``k`` of unigram and ordered-pair (i < j) counts of one token list.

    Ranking: count descending, then first-seen order, where every unigram
    precedes every pair, unigrams by first position, pairs by first (i, j).
    Exact with pruning: first terms a are visited by count descending, as many
    at a time as fit ``PAIR_CELLS`` cells; the counts of all pairs (a, b) come
    from one pass (number of a's before each position, summed per b), and the
    visit stops once c_a * c_max can no longer reach the current k-th entry.
    """
    if not tokens or k <= 0:
        return []
    inv, terms = pd.factorize(np.asarray(tokens, dtype=object))   # by a hash table, in first-seen order
    cnt = np.bincount(inv)
    places = np.argsort(inv, kind="stable")                       # positions of each term, one term after another
    ends = np.cumsum(cnt)
    starts = ends - cnt
    first = places[starts]
    v, n = len(terms), len(inv)
    if v > k:   # the k-th largest count; terms are in first-seen order, which breaks ties
        best = [(-int(cnt[t]), 0, int(first[t]), 0, int(t), -1) for t in np.argsort(-cnt, kind="stable")[:k]]
    else:
        best = sorted((-int(cnt[t]), 0, int(first[t]), 0, t, -1) for t in range(v))

    def reachable(bound: int) -> bool:
        if len(best) < k:
            return True
        kth = -best[-1][0]
        return bound > kth or (bound == kth and best[-1][1] == 1)

    c_max = int(cnt.max())
    keys = inv[places] * n + places
    order = np.argsort(-cnt, kind="stable")
    for lo in range(0, v, max(1, PAIR_CELLS // n)):
        a = order[lo:lo + max(1, PAIR_CELLS // n)]
        if not reachable(int(cnt[a[0]]) * c_max):
            break
        is_a = inv[:, None] == a
        before = np.cumsum(is_a, axis=0) - is_a    # a's strictly before each position
        pc = np.add.reduceat(before[places], starts, axis=0)
        full = len(best) == k                      # a unigram of the same count comes before a pair
        b, x = np.nonzero(pc >= max(1, (-best[-1][0] + (best[-1][1] == 0)) if full else 1))
        c = pc[b, x]
        if len(c) > k:
            some = c >= np.partition(c, len(c) - k)[len(c) - k]
            b, x, c = b[some], x[some], c[some]
        i0 = first[a[x]]
        j0 = places[np.searchsorted(keys, b * n + i0, "right")]   # the second term's first position after i0
        top = np.lexsort((j0, i0, -c))[:k]
        best = sorted(best + [(-int(c[t]), 1, int(i0[t]), int(j0[t]), int(a[x[t]]), int(b[t])) for t in top])[:k]
    out = []
    for negc, kind, _, _, x, y in best:
        label = terms[x] if kind == 0 else terms[x] + " " + terms[y]
        out.append((negc, kind, 0, 0, label))
    return out


def pair_counts(tokens: DataFrame, k: int = 5) -> DataFrame:
    """A16 (the reference calls it "textrank"): ``(doc_id, rank, term, count)``.

    Unigrams plus all ordered position pairs i < j of the document (not just
    adjacent ones), top ``k`` by count with first-seen tie order (Q15).
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, toks in pdf[["doc_id", "tokens"]].itertuples(index=False):
                for r, e in enumerate(_top_combinations(list(toks), k), 1):
                    rows.append((doc_id, r, e[4], -e[0]))
            yield pd.DataFrame(rows, columns=["doc_id", "rank", "term", "count"]).astype(
                {"doc_id": "int64", "rank": "int32", "count": "int64"})

    return tokens.select("doc_id", "tokens").mapInPandas(run, "doc_id long, rank int, term string, count long")
