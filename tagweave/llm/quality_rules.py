"""Quality rules on repetition, by suffix array and longest-common-prefix intervals.

Within each document the suffixes that share their first ``min_repeat`` words with another one are sorted by
prefix doubling (ranks of prefixes of 8, 16, 32 ... words; a suffix leaves as soon as its rank is unique).
Neighbours in suffix order get their exact longest common prefix from the kept ranks. Intervals of that LCP
array whose suffixes are preceded by different words are the maximal repeated substrings; the union of their
spans is the repeated part of the document. A document is rejected if that part covers more than
``max_covered`` of its words or the longest repeat is longer than ``max_longest`` words and more than
``max_longest_share`` of the document.

Documents of an Arrow slice (0.5 MB, or one longer document) are sorted in one go, with the document as the
first part of every rank, so no shuffle is needed and memory is bounded by the slice or the longest document.

Defined results: a null or empty text has no words and is rejected (fewer than ``min_words``); rows are
independent, repeated rows get equal results; an empty table gives an empty result; extra columns stay in
``apply_rules``; the added columns replace columns of the same name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.llm.shared import text_of
from tagweave.llm.words import U, _powers, complete, mix, ngrams, slices, split_words, string_bytes

MIN_REPEAT = 8
MIN_WORDS = 20
MAX_COVERED = 30          # percent of words inside repeats
MAX_LONGEST = 64          # words
MAX_LONGEST_SHARE = 10    # percent of the document: a repeat stands twice, so well under half of MAX_COVERED

STATS = T.StructType([T.StructField(n, T.LongType()) for n in
                      ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat",
                       "n_maximal")])
SYMBOL_BYTES = np.zeros(256, dtype=bool)
SYMBOL_BYTES[[ord(c) for c in "#*$%&|<>"]] = True


def suffix_intervals(hashes: np.ndarray, doc: np.ndarray, first: np.ndarray, valid: np.ndarray, min_repeat: int):
    """Repeated suffixes of each document, in suffix order.

    ``first`` hashes the ``min_repeat`` words from each position, ``valid`` says where so many are left.
    Returns (positions in suffix order, LCP with the suffix before it, 0 where that is another document's).

    A rank is the index, in the order so far, of the first suffix with the same prefix. Suffixes up to
    ``min_repeat`` words after a repeated one are ranked too: that is where a longer comparison ends.
    """
    n = len(hashes)
    none = np.zeros(0, dtype=np.int64)
    pos = np.flatnonzero(valid)
    order = pos[np.lexsort((first[pos], doc[pos]))]
    same = np.zeros(len(order) + 1, dtype=bool)
    same[1:-1] = (doc[order[1:]] == doc[order[:-1]]) & (first[order[1:]] == first[order[:-1]])
    act = np.sort(order[same[1:] | same[:-1]])
    if not len(act):
        return none, none
    end = np.searchsorted(doc, doc, "right")  # of each word's document
    near = np.zeros(n + min_repeat + 1, dtype=np.int64)
    np.add.at(near, act, 1)
    np.add.at(near, act + min_repeat + 1, -1)
    region = np.flatnonzero(np.cumsum(near)[:n])

    def word(p):  # the word hash at p, 0 after the end of the document that p started in
        return np.where(p < end[region], hashes[np.minimum(p, n - 1)], np.uint64(0))

    cols = [doc[region], *[word(region + j) for j in range(min_repeat)]]
    order = np.lexsort(cols[::-1])
    new = np.zeros(len(order), dtype=bool)
    for c in cols:
        new[1:] |= c[order][1:] != c[order][:-1]
    rank = -1 - np.arange(n, dtype=np.int64)  # outside the region: of its own
    index = np.arange(len(order))
    rank[region[order]] = np.maximum.accumulate(np.where(new, index, 0))
    ranks, span, todo = [rank], min_repeat, act
    while True:
        _, inverse, count = np.unique(rank[todo], return_inverse=True, return_counts=True)
        todo = todo[count[inverse] > 1]
        if not len(todo):
            break
        far = todo + span
        tail = np.where(far < end[todo], rank[np.minimum(far, n - 1)], -1)
        order = np.lexsort((tail, rank[todo]))
        group, tail, index = rank[todo][order], tail[order], np.arange(len(order))
        lead = np.concatenate(([True], group[1:] != group[:-1]))
        part = lead | np.concatenate(([True], tail[1:] != tail[:-1]))
        at = lambda flag: np.maximum.accumulate(np.where(flag, index, 0))
        rank = rank.copy()
        rank[todo[order]] = group + at(part) - at(lead)
        ranks.append(rank)
        span *= 2
    sa = act[np.argsort(rank[act], kind="stable")]
    # exact LCP of neighbours: at most one step at each level, then word by word
    a, b = sa[:-1], sa[1:]
    lcp = np.zeros(len(a), dtype=np.int64)
    live = doc[a] == doc[b]
    for l in range(len(ranks) - 1, -1, -1):
        x, y = a + lcp, b + lcp
        ok = live & (x < end[a]) & (y < end[b])
        ok[ok] = ranks[l][x[ok]] == ranks[l][y[ok]]
        lcp[ok] += min_repeat << l
    for _ in range(min_repeat):
        x, y = a + lcp, b + lcp
        ok = live & (x < end[a]) & (y < end[b])
        ok[ok] = hashes[x[ok]] == hashes[y[ok]]
        lcp[ok] += 1
        live = live & ok
    return sa, np.concatenate(([0], np.where(lcp >= min_repeat, lcp, 0)))


def maximal_repeats(sa: np.ndarray, lcp: np.ndarray, hashes: np.ndarray, doc: np.ndarray):
    """(representative suffix, length) of each LCP interval whose occurrences follow different words."""
    n = len(sa)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    prev = np.where((sa > 0) & (doc[np.maximum(sa - 1, 0)] == doc[sa]), hashes[np.maximum(sa - 1, 0)], np.uint64(0))
    differs = np.concatenate(([0], np.cumsum(prev[1:] != prev[:-1])))
    found, stack = [], []  # stack of (lcp value, left bound)
    for i, v in enumerate([*lcp[1:].tolist(), 0], start=1):
        left = i - 1
        while stack and stack[-1][0] > v:
            value, left = stack.pop()
            if differs[i - 1] > differs[left]:
                found.append((left, value))
        if v and (not stack or stack[-1][0] < v):
            stack.append((v, left))
    where = np.array([x for x, _ in found], dtype=np.int64)
    return sa[where], np.array([v for _, v in found], dtype=np.int64)


def _line_stats(data, offsets, words):
    """Repeated lines with a word, per document: lines equal to an earlier line of the document."""
    n = len(data)
    cuts = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate((offsets[:-1], cuts + 1)))
    start = start[start < n]
    if not len(start):
        return np.zeros(len(offsets) - 1, dtype=np.int64)
    doc = np.searchsorted(offsets, start, "right") - 1
    stop = np.minimum(np.append(start[1:], n), offsets[doc + 1])
    stop = stop - ((stop > start) & (data[np.maximum(stop - 1, 0)] == 10))
    has = np.searchsorted(words.start, start) < np.searchsorted(words.start, stop)
    start, stop, doc = start[has], stop[has], doc[has]
    if not len(start):
        return np.zeros(len(offsets) - 1, dtype=np.int64)
    up, down = _powers(n + 1)
    total = np.concatenate((np.zeros(1, dtype=U), np.cumsum((data.astype(U) + U(1)) * up[:n])))
    h = mix((total[stop] - total[start]) * down[start] + (stop - start).astype(U))
    order = np.lexsort((h, doc))
    again = np.zeros(len(order), dtype=bool)
    again[1:] = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return np.bincount(doc[order[again]], minlength=len(offsets) - 1)


def measure(column: pa.Array, min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """Statistics of each text of an Arrow string column."""
    data, offsets = string_bytes(column)
    docs = len(offsets) - 1
    w = split_words(data, offsets)
    doc, counts = w.doc(), w.counts
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # code points
    sym = np.concatenate(([0], np.cumsum(SYMBOL_BYTES[data])))
    per = lambda v: np.bincount(doc, weights=v, minlength=docs).astype(np.int64)
    out = {"n_words": counts, "word_chars": per(lead[w.end] - lead[w.start]),
           "n_symbols": sym[offsets[1:]] - sym[offsets[:-1]],
           "n_dup_lines": _line_stats(data, offsets, w)}
    sa, lcp = suffix_intervals(w.hash, doc, ngrams(w, min_repeat), complete(w, min_repeat), min_repeat)
    if len(sa):
        best = np.maximum(lcp, np.append(lcp[1:], 0))
        # union of the spans [suffix, suffix + longest repeat there)
        far = np.zeros(len(w.hash), dtype=np.int64)
        far[sa] = sa + best
        covered = np.maximum.accumulate(far) > np.arange(len(far))
        out["n_repeat_words"] = per(covered)
        out["longest_repeat"] = np.zeros(docs, dtype=np.int64)
        np.maximum.at(out["longest_repeat"], doc[sa], best)
        rep, _ = maximal_repeats(sa, lcp, w.hash, doc)
        out["n_maximal"] = np.bincount(doc[rep], minlength=docs)
    else:
        out |= {k: np.zeros(docs, dtype=np.int64) for k in ("n_repeat_words", "longest_repeat", "n_maximal")}
    return {f.name: np.asarray(out[f.name], dtype=np.int64) for f in STATS}


def repetition_stats(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (columns ``keep``, all by default) plus the columns of ``STATS``."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in STATS.names]
    temp = "_measured_text"
    src = docs.select(*keep, text_of(text).alias(temp))
    schema = T.StructType([*src.schema.fields[:-1], *STATS.fields])

    def run(batches):
        for batch in batches:
            column = batch.column(len(keep))
            for i, j in slices(column):
                stats = measure(column.slice(i, j - i))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).slice(i, j - i) for k in range(len(keep))],
                     *[pa.array(v, type=pa.int64()) for v in stats.values()]],
                    names=[*keep, *stats])

    return src.mapInArrow(run, schema)


def verdict(min_words: int = MIN_WORDS, max_covered: int = MAX_COVERED, max_longest: int = MAX_LONGEST,
            max_longest_share: int = MAX_LONGEST_SHARE):
    """(base_failed, kept) over the columns of ``STATS``."""
    n, rep, longest = F.col("n_words"), F.col("n_repeat_words"), F.col("longest_repeat")
    failed = (n < min_words) | (100 * rep > max_covered * n)
    too_long = (longest > max_longest) & (100 * longest > max_longest_share * n)
    return failed, ~failed & ~too_long


def apply_rules(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """``docs`` without the rejected documents, columns unchanged."""
    names = docs.columns
    inner = [f"_c{i}" for i in range(len(names))]  # no clash with the statistics
    src = docs.toDF(*inner)
    out = repetition_stats(src, inner[names.index(text)])
    _, kept = verdict(**limits)
    return out.where(kept).select(*[F.col(a).alias(b) for a, b in zip(inner, names)])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    failed, kept = verdict()
    return repetition_stats(docs, keep=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), kept.alias("kept"))


# a repeat of more than 64 words and a tenth of the document is a repeated window of `m` words
OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, ws, len(ws) AS n_words, greatest(65, len(ws) // 10 + 1) AS m,
         coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM w),
l AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w),
dup AS (
  SELECT doc_id, sum(c - 1)::BIGINT AS n_dup_lines FROM (
    SELECT doc_id, line, count(*) AS c FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line)
  GROUP BY doc_id),
g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM s)),
r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
cov AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM r, (SELECT unnest(range(0, 8)) AS j) GROUP BY doc_id),
long AS (
  SELECT DISTINCT doc_id FROM (
    SELECT doc_id, array_to_string(ws[i:i + m - 1], ' ') AS g FROM (
      SELECT doc_id, ws, m, unnest(range(1, n_words - m + 2)) AS i
      FROM s JOIN cov USING (doc_id) WHERE n_repeat_words >= m))
  GROUP BY doc_id, g HAVING count(*) > 1),
o AS (
  SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, long.doc_id IS NOT NULL AS too_long
  FROM s LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN long USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR too_long) AS kept
FROM o"""
