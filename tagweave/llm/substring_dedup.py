"""Repeated substrings by compaction of a word De Bruijn graph.

The edges of the graph are the windows of ``K`` consecutive words of all documents, its nodes the K - 1 words
two edges share. Documents are walks; what repeats is removed everywhere but in the first document, by id.

1. Paths. The windows of a document that share one occurrence of their minimizer (the smallest hashed run of
   ``M`` words in the window) form a nonbranching path. Windows with equal words have equal minimizers, so
   equal windows can only be in paths with equal minimizers, and paths with a minimizer found once are done.
2. Compaction. Paths with equal words are one: a partial aggregation and a join give each occurrence its
   source, the first document and position that has it. Consecutive occurrences of a document whose sources
   are consecutive too are joined into one long span with one source coordinate.
3. Branches. Paths with the same minimizer and different words share some windows at most. Of each distinct
   path the source's occurrence is cut into its windows, which are compared by hash.
4. Verification. Every long span and its source coordinate are read from the texts again and compared by a
   second, independent hash of the words between them; a span that differs stays. Windows carry both hashes.

Hashes are 64 bits, compared as 128 (minimizer and path, or two window hashes). A passage in a third of all
documents is one key in the aggregations (combined before the shuffle) and in the joins (split by AQE).

Defined results: null text has no words; documents shorter than K words keep all; documents with equal ids
count as the same document, so neither removes words of the other; a null id counts as the largest; an empty
table gives an empty result; extra columns stay, the added columns replace those of the same name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.llm.shared import drop_stage, stage, staged, text_batches, text_of
from tagweave.llm.words import U, Words, _powers, complete, mix, ngrams, slices, split_words, string_bytes

K = 13
M = 4
DOC = ["d", "th"]  # a document: its id (null last) and its text's hash


def _keys(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.withColumns({
        "d": F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1)),
        "th": F.xxhash64(text_of(text))})


def minimizer_paths(w: Words, k: int = K, m: int = M):
    """(minimizer hash, path hash, document, first word, windows) of each path of the documents."""
    n = len(w.hash)
    valid = complete(w, k)
    grams = ngrams(w, m)
    span = k - m + 1
    best, at = grams.copy(), np.arange(n)
    for j in range(1, span):  # leftmost smallest of the m-grams that start in the window
        other = grams[j:]
        less = np.flatnonzero(other < best[:n - j])
        best[less], at[less] = other[less], less + j
    pos = np.flatnonzero(valid)
    if not len(pos):
        e = np.zeros(0, dtype=np.int64)
        return e.astype(U), e.astype(U), e, e, e
    doc = w.doc()
    a, d = at[pos], doc[pos]
    new = np.ones(len(pos), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(pos)))
    start = pos[first]
    # polynomial hash over the words of the path, from prefix sums
    return best[start], _span_hash(w, start, start + count + k - 1, 1), d[first], start - w.ptr[d[first]], count


def _span_hash(w: Words, a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """Hash of the words [a, b); different seeds give independent hashes."""
    up, down = _powers(len(w.hash) + 1)
    total = np.zeros(len(w.hash) + 1, dtype=U)
    np.cumsum(mix(w.hash + U(seed * 0x51ED270B)) * up[:len(w.hash)], out=total[1:])
    return mix((total[b] - total[a]) * down[np.minimum(a, len(down) - 1)] + (b - a).astype(U))


def _words(column: pa.Array) -> Words:
    return split_words(*string_bytes(column))


def _long(x) -> pa.Array:
    x = np.asarray(x)
    return pa.array(x.view(np.int64) if x.dtype == U else x.astype(np.int64))


def paths(docs: DataFrame) -> DataFrame:
    """(g, s, d, th, at): minimizer, path hash, document; ``at`` packs first word and number of windows."""
    def run(batches):
        for batch in batches:
            for i, j in slices(batch.column(2)):
                part = batch.slice(i, j - i)
                w = _words(part.column(2))
                g, s, doc, start, count = minimizer_paths(w)
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [_long(g), _long(s), part.column(0).take(take), part.column(1).take(take),
                     _long(start * 16 + count)], names=["g", "s", *DOC, "at"])

    src = docs.select(*DOC, text_of().alias("_text"))
    return src.mapInArrow(run, "g long, s long, d long, th long, at long")


# requests for the second look at the texts
SPAN, EDGES = 0, 1


def _look(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """Answer the requests (d, th, kind, a, n): hash ``n`` words from word ``a`` (SPAN), or the ``n`` windows
    that start at ``a`` and after (EDGES). Rows (kind, d, th, a, n, e1, e2)."""
    asked = requests.groupBy(*DOC).agg(F.collect_set(F.struct("kind", "a", "n")).alias("ask"))
    src = (docs.select(*DOC, text_of().alias("_text")).join(asked, DOC)
               .dropDuplicates(DOC).select(*DOC, "_text", "ask"))

    def run(batches):
        for batch in batches:
            for i, j in slices(batch.column(2)):
                part = batch.slice(i, j - i)
                w = _words(part.column(2))
                ask = part.column(3)
                flat = ask.flatten()
                kind, a, n = (flat.field(c).to_numpy(zero_copy_only=False) for c in range(3))
                doc = np.repeat(np.arange(len(part)), ask.value_lengths().to_numpy(zero_copy_only=False))
                out = []
                for k in (SPAN, EDGES):
                    x = kind == k
                    dd, aa, nn = doc[x], a[x], n[x]
                    if k == EDGES:  # one row per window
                        dd, step = np.repeat(dd, nn), np.arange(nn.sum()) - np.repeat(np.cumsum(nn) - nn, nn)
                        aa, nn = np.repeat(aa, nn) + step, np.full(len(dd), 1)
                    lo = w.ptr[dd] + aa
                    hi = np.minimum(lo + (nn if k == SPAN else K), w.ptr[dd + 1])
                    out.append((np.full(len(dd), k), dd, aa, nn, _span_hash(w, lo, hi, 2), _span_hash(w, lo, hi, 3)))
                kind, dd, aa, nn, e1, e2 = (np.concatenate(c) for c in zip(*out))
                take = pa.array(dd)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kind.astype(np.int32)), part.column(0).take(take), part.column(1).take(take), _long(aa),
                     _long(nn), _long(e1), _long(e2)], names=["kind", *DOC, "a", "n", "e1", "e2"])

    return src.mapInArrow(run, "kind int, d long, th long, a long, n long, e1 long, e2 long")


def long_spans(copies: DataFrame) -> DataFrame:
    """Join consecutive copied paths (d, th, a, n, sd, sth, sa) with consecutive sources into long spans."""
    by_doc = Window.partitionBy(*DOC).orderBy("a")
    follows = ((F.lag("sd").over(by_doc) == F.col("sd")) & (F.lag("sth").over(by_doc) == F.col("sth"))
               & (F.lag("sa").over(by_doc) - F.lag("a").over(by_doc) == F.col("sa") - F.col("a"))
               & (F.lag("a").over(by_doc) + F.lag("n").over(by_doc) == F.col("a")))
    runs = (copies.withColumn("_new", F.when(follows, 0).otherwise(1))
                  .withColumn("_run", F.sum("_new").over(by_doc)))
    return (runs.groupBy(*DOC, "_run")
                .agg(F.min("a").alias("a"), F.sum("n").alias("n"), F.first("sd").alias("sd"),
                     F.first("sth").alias("sth"), F.min("sa").alias("sa"))
                .select(*DOC, "a", (F.col("n") + K - 1).alias("n"), "sd", "sth", "sa"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(d, th, a, n): word spans to remove; ``docs`` has d, th and text."""
    spark = docs.sparkSession
    # paths whose minimizer occurs again
    again, p1 = staged(paths(docs).groupBy("g").count().where("count > 1").select("g"), "dedup-minimizers")
    found = paths(docs).join(again, "g", "left_semi")
    found, p2 = staged(found.select("g", "s", *DOC, F.shiftright("at", 4).alias("a"),
                                    F.col("at").bitwiseAND(15).alias("n")), "dedup-paths")
    drop_stage(spark, p1)
    # compaction: equal paths and their source
    src = (found.groupBy("g", "s").agg(F.min(F.struct("d", "th", "a")).alias("src"))
                .select("g", "s", F.col("src.d").alias("sd"), F.col("src.th").alias("sth"), F.col("src.a").alias("sa")))
    placed, p3 = staged(found.join(src, ["g", "s"]).drop("s"), "dedup-placed")
    spans = stage(long_spans(placed.where("d > sd").drop("g")), "dedup-spans")
    # branches: minimizers with several distinct paths; all their occurrences in the source documents
    branching = (found.select("g", "s").distinct().groupBy("g").count().where("count > 1").select("g"))
    heads = (placed.where("d = sd").join(branching, "g", "left_semi")
                   .select(*DOC, F.lit(EDGES).alias("kind"), "a", "n"))
    own = spans.select(*DOC, F.lit(SPAN).alias("kind"), "a", "n")
    theirs = spans.select(F.col("sd").alias("d"), F.col("sth").alias("th"), F.lit(SPAN).alias("kind"),
                          F.col("sa").alias("a"), "n").distinct()
    seen = stage(_look(docs, heads.unionByName(own).unionByName(theirs)), "dedup-seen")
    for p in (p2, p3):
        drop_stage(spark, p)
    # verification of the long spans, and windows found in an earlier document
    text = seen.where(F.col("kind") == SPAN).select(*DOC, "a", "n", "e1", "e2")
    source = text.select(F.col("d").alias("sd"), F.col("th").alias("sth"), F.col("a").alias("sa"), "n",
                         F.col("e1").alias("f1"), F.col("e2").alias("f2"))
    same = (spans.join(text, [*DOC, "a", "n"]).join(source, ["sd", "sth", "sa", "n"])
                 .where("e1 = f1 and e2 = f2").select(*DOC, "a", "n"))
    edges = seen.where(F.col("kind") == EDGES)
    first = edges.groupBy("e1", "e2").agg(F.min("d").alias("sd"), F.max("d").alias("ld")).where("ld > sd")
    windows = (edges.join(first, ["e1", "e2"]).where("d > sd")
                    .select(*DOC, "a", F.lit(K).cast("long").alias("n")))
    return same.unionByName(windows)


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with ``text`` as the kept words joined by one space, plus ``n_words`` and ``n_removed``."""
    added = ("n_words", "n_removed")
    keep = [c for c in docs.columns if c != text and c not in added]
    base = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(keep)], F.col(key).alias("_key"),
                       F.col(text).alias("text"))
    base = _keys(base, "text", "_key").drop("_key")
    text_batches(docs.sparkSession)
    spans = repeated_spans(base.select(*DOC, "text"))
    spans = stage(spans.groupBy(*DOC).agg(F.collect_set(F.struct("a", "n")).alias("_cut")), "dedup-cuts")
    src = base.join(spans, DOC, "left").select(*[f"_c{i}" for i in range(len(keep))],
                                               text_of().alias("text"), "_cut")
    inner = src.schema.fields[:len(keep)]
    schema = T.StructType([*inner, T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()),
                           T.StructField("n_removed", T.LongType())])
    c = len(keep)

    def run(batches):
        for batch in batches:
            for i, j in slices(batch.column(c)):
                part = batch.slice(i, j - i)
                w = _words(part.column(c))
                cut = part.column(c + 1).fill_null([])
                flat = cut.flatten()
                a, n = (flat.field(f).to_numpy(zero_copy_only=False) for f in range(2))
                doc = np.repeat(np.arange(len(part)), cut.value_lengths().to_numpy(zero_copy_only=False))
                depth = np.zeros(len(w.hash) + 1, dtype=np.int64)
                np.add.at(depth, w.ptr[doc] + a, 1)
                np.add.at(depth, np.minimum(w.ptr[doc] + a + n, w.ptr[doc + 1]), -1)
                gone = np.cumsum(depth[:-1]) > 0
                kept, removed = join_words(w, ~gone)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(k) for k in range(c)], kept, _long(w.counts), _long(removed)], names=schema.names)

    out = src.mapInArrow(run, schema)
    return out.select(*[F.col(f"_c{i}").alias(name) for i, name in enumerate(keep)], F.col("text").alias(text), *added)


def join_words(w: Words, keep: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The kept words of each document joined by one space; the number of words not kept."""
    idx = np.flatnonzero(keep)
    doc = w.doc()[idx]
    last = np.ones(len(idx), dtype=bool)
    last[:-1] = doc[1:] != doc[:-1]
    size = w.end[idx] - w.start[idx] + ~last
    stop = np.cumsum(size)
    total = int(stop[-1]) if len(stop) else 0
    src = np.arange(total) + np.repeat(w.start[idx] - (stop - size), size)
    out = np.append(w.data, np.uint8(32))[src]
    out[stop[~last] - 1] = 32
    docs = len(w.ptr) - 1
    n_kept = np.bincount(doc, minlength=docs)
    off = np.concatenate(([0], np.cumsum(np.bincount(doc, weights=size, minlength=docs).astype(np.int64))))
    text = pa.Array.from_buffers(pa.large_string(), docs, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(out)])
    return text.cast(pa.string()), w.counts - n_kept


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
f AS (SELECT g, min(doc_id) AS first_doc FROM g GROUP BY g),
cut AS (
  SELECT DISTINCT doc_id, i + j AS pos FROM g JOIN f USING (g), (SELECT unnest(range(0, 13)) AS j)
  WHERE first_doc < doc_id),
t AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
k AS (
  SELECT t.doc_id, count(*) AS n_words, count(cut.pos) AS n_removed,
         string_agg(word, ' ' ORDER BY t.pos) FILTER (WHERE cut.pos IS NULL) AS kept
  FROM t LEFT JOIN cut ON t.doc_id = cut.doc_id AND t.pos = cut.pos GROUP BY t.doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id"""
