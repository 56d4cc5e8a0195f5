"""Repeated byte strings by merging Burrows-Wheeler transforms of shards.

A byte goes when a string of ``K`` bytes covers it that also starts anywhere else, in the same document or
another. Sorting the suffixes of a corpus in one array is out of the question, so its suffixes are dealt by
content first, and each part is indexed by shards that are merged:

1. Pieces. Every window of K bytes has an anchor, its leftmost smallest hashed run of 2K/5 bytes. Consecutive
   windows with the same anchor occurrence are a piece of text. Equal windows have equal anchors, so suffixes
   that agree on K bytes are in pieces of the same anchor; an anchor that occurs once is done.
2. Copies first. Equal pieces are one piece with a weight (the number of its occurrences), combined before the
   shuffle: a passage in a third of all documents is one row.
3. Shards. The pieces of some anchors (64 KB) are cut into shards, and each is indexed alone: its suffixes are
   sorted by doubling, and its Burrows-Wheeler transform lists what stands before each sorted suffix. The
   alphabet is the K/16-byte strings of the block, the end of a piece equals nothing.
4. Interleave refinement. The transforms are merged without comparing suffixes: starting from the shards one
   after another, each round deals the interleave stably by the symbols of the transforms, after which it is
   in the order of the first t symbols. The round in which a boundary appears is the common prefix there; the
   intervals without a boundary after 16 rounds agree on K bytes. An interval of weight 2 or more is repeated.

An anchor with more than ``CAP`` distinct pieces (a short hot passage in many contexts) is no block of one
task: its windows are compared one by one as 128-bit hashes, combined before the shuffle; nothing is dropped.
Equality in the shuffles is by 128 bits of hash (anchor and piece).

Defined results: null text is empty; texts under K bytes keep all; rows with equal or null ids are separate
documents (they are told apart by 64 bits of the text's hash, and equal rows are copies of one another); an
empty table gives an empty result; extra columns stay, the added columns replace those of the same name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.llm.shared import drop_stage, staged, text_batches, text_of
from tagweave.llm.words import U, _powers, mix, slices, string_bytes

K = 400
ROUNDS = 16           # rounds of the merge; a symbol is K / ROUNDS bytes
CAP = 512             # distinct pieces of an anchor that one task merges
BLOCK = 1 << 16       # bytes of pieces in a block
SHARD = 1 << 14       # bytes of a shard
DOC = ["d", "th"]


# ---------------------------------------------------------------------------
# one block: shards, transforms, merge


def _order(x: np.ndarray) -> np.ndarray:
    """Stable order of small integers by radix passes of 16 bits."""
    out = np.argsort(x.astype(np.uint16), kind="stable")
    if len(x) and x.max() >= 1 << 16:
        out = out[np.argsort((x[out] >> 16).astype(np.uint16), kind="stable")]
    return out


def _dense(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the pairs (first, second) and their dense ranks."""
    order = _order(second)
    order = order[_order(first[order])]
    a, b = first[order], second[order]
    step = np.zeros(len(order), dtype=np.int64)
    step[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.cumsum(step)
    return order, rank


def _symbols(data: np.ndarray, left: np.ndarray, m: int) -> np.ndarray:
    """Number of the ``m`` bytes from each position; positions with fewer left have numbers of their own."""
    n = len(data)
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, dtype=U)
    np.cumsum((data.astype(U) + U(1)) * up[:n], out=total[1:])
    whole = np.flatnonzero(left >= m)
    values, at = np.unique((total[whole + m] - total[whole]) * down[whole], return_inverse=True)
    out = np.empty(n, dtype=np.int64)
    out[whole] = at
    short = left < m
    out[short] = len(values) + np.arange(short.sum())
    return out


def shard_transform(sym: np.ndarray, ahead, behind: np.ndarray, lo: int, hi: int, m: int, k: int):
    """(sorted suffixes, transform) of the positions [lo, hi): suffixes in the order of their first ``k`` bytes."""
    rank = np.unique(sym[lo:hi], return_inverse=True)[1]
    depth, order = m, _order(rank)
    while depth < k:
        order, rank = _dense(rank, rank[ahead(lo, hi, depth) - lo])
        depth *= 2
    return order + lo, sym[behind[order + lo]]


def merge_transforms(transforms: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(z, lcp): the shard of each suffix in the merged order, and the symbols it shares with the one before
    it, ``rounds`` where that is all the rounds saw."""
    sizes = [len(t) for t in transforms]
    n = sum(sizes)
    symbols = np.concatenate(transforms) if transforms else np.zeros(0, dtype=np.int64)
    z = np.repeat(np.arange(len(sizes)), sizes).astype(np.uint8 if len(sizes) < 256 else np.uint16)
    lcp = np.full(n, rounds, dtype=np.int64)
    lcp[:1] = 0
    block = np.zeros(n, dtype=np.int64)
    here = np.empty(n, dtype=np.int64)
    for t in range(rounds):
        here[np.argsort(z, kind="stable")] = symbols   # each shard's transform, read in order
        order = _order(here)
        z, block, s = z[order], block[order], here[order]
        new = np.zeros(n, dtype=bool)
        new[1:] = (s[1:] != s[:-1]) | (block[1:] != block[:-1])
        lcp[new & (lcp == rounds)] = t
        block = np.cumsum(new)
        if n and block[-1] == n - 1:
            break
    return z, lcp


def repeated_starts(data: np.ndarray, ptr: np.ndarray, weight: np.ndarray, k: int = K, shard: int = SHARD) -> np.ndarray:
    """Whether the ``k`` bytes from each position are found twice or more, counting piece p ``weight[p]`` times.

    ``data[ptr[p]:ptr[p + 1]]`` is piece p, of ``k`` bytes at least."""
    n, m = len(data), k // ROUNDS
    size = np.diff(ptr)
    piece = np.repeat(np.arange(len(size)), size)
    pos = np.arange(n)
    left = ptr[piece + 1] - pos
    sym = _symbols(data, left, m)
    behind = np.where(pos - ptr[piece] >= m, pos - m, pos - m + size[piece])

    def ahead(lo, hi, by):
        return np.where(left[lo:hi] > by, pos[lo:hi] + by, pos[lo:hi] + by - size[piece[lo:hi]])

    at, transforms, p = [], [], 0
    while p < len(size):  # shards are whole pieces
        q = max(p + 1, int(np.searchsorted(ptr, ptr[p] + shard, "right")) - 1)
        order, transform = shard_transform(sym, ahead, behind, int(ptr[p]), int(ptr[q]), m, k)
        at.append(order)
        transforms.append(transform)
        p = q
    z, lcp = merge_transforms(transforms, ROUNDS)
    suffix = np.empty(n, dtype=np.int64)
    suffix[np.argsort(z, kind="stable")] = np.concatenate(at)
    interval = np.cumsum(lcp < ROUNDS) - (1 if n else 0)
    total = np.bincount(interval, weights=weight[piece[suffix]])
    out = np.zeros(n, dtype=bool)
    out[suffix] = total[interval] >= 2
    return out & (left >= k)


# ---------------------------------------------------------------------------
# pieces


def _span_hash(data: np.ndarray, a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=U)
    code = mix(np.arange(256, dtype=U) + U(seed << 32))
    np.cumsum(code[data] * up[:len(data)], out=total[1:])
    return mix((total[b] - total[a]) * down[np.minimum(a, len(down) - 1)] + (b - a).astype(U))


def anchors(data: np.ndarray, offsets: np.ndarray, k: int = K):
    """(anchor hash, piece hash, document, first byte, windows) of the pieces of the documents."""
    q = 2 * k // 5
    n = len(data)
    none = np.zeros(0, dtype=np.int64)
    if n < k:
        return none.astype(U), none.astype(U), none, none, none
    h = _span_hash(data, np.arange(n - q + 1), np.arange(q, n + 1), 1)
    best, at = h, np.arange(len(h), dtype=np.int32)
    span, have = k - q + 1, 1
    while have < span:  # leftmost smallest of the runs that start in the window; the last step overlaps
        step = min(have, span - have)
        right, right_at = best[step:], at[step:]
        best, at = best[:len(right)], at[:len(right)]
        less = right < best
        best, at = np.where(less, right, best), np.where(less, right_at, at)
        have += step
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    pos = np.flatnonzero(offsets[doc[:n - k + 1] + 1] - np.arange(n - k + 1) >= k)
    if not len(pos):
        return none.astype(U), none.astype(U), none, none, none
    a, d = at[pos], doc[pos]
    new = np.ones(len(pos), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(pos)))
    start = pos[first]
    return h[a[first]], _span_hash(data, start, start + count + k - 1, 2), d[first], start - offsets[d[first]], count


def _long(x) -> pa.Array:
    x = np.asarray(x)
    return pa.array(x.view(np.int64) if x.dtype == U else x.astype(np.int64))


def pieces(docs: DataFrame, k: int = K) -> DataFrame:
    """(g, s, d, th, a, n): anchor hash, piece hash, document, first byte and number of windows of each piece."""
    def run(batches):
        for batch in batches:
            for i, j in slices(batch.column(2)):
                part = batch.slice(i, j - i)
                g, s, doc, a, n = anchors(*string_bytes(part.column(2)), k)
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [_long(g), _long(s), part.column(0).take(take), part.column(1).take(take), _long(a),
                     pa.array(n.astype(np.int32))], names=["g", "s", *DOC, "a", "n"])

    return docs.select(*DOC, "text").mapInArrow(run, "g long, s long, d long, th long, a long, n int")


PIECE = ["g", "s", "w", "n"]


def _cut_pieces(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(g, s, w, n, bytes) of the wanted pieces (g, s, w, d, th, a, n), read from one occurrence each."""
    asked = wanted.groupBy(*DOC).agg(F.collect_list(F.struct("a", *PIECE)).alias("ask"))
    src = docs.select(*DOC, "text").join(asked, DOC).dropDuplicates(DOC).select("text", "ask")

    def run(batches):
        for batch in batches:
            for i, j in slices(batch.column(0)):
                part = batch.slice(i, j - i)
                data, offsets = string_bytes(part.column(0))
                ask = part.column(1)
                flat = ask.flatten()
                doc = np.repeat(np.arange(len(part)), ask.value_lengths().to_numpy(zero_copy_only=False))
                a = offsets[doc] + flat.field(0).to_numpy(zero_copy_only=False)
                size = flat.field(4).to_numpy(zero_copy_only=False).astype(np.int64) + k - 1
                for lo, hi in _runs_of(size, 1 << 22):
                    stop = np.cumsum(size[lo:hi])
                    at = np.arange(stop[-1]) + np.repeat(a[lo:hi] - (stop - size[lo:hi]), size[lo:hi])
                    ends = np.concatenate(([0], stop)).astype(np.int32)
                    text = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends), pa.py_buffer(data[at])])
                    yield pa.RecordBatch.from_arrays(
                        [*[flat.field(f).slice(lo, hi - lo) for f in range(1, 5)], text], names=[*PIECE, "bytes"])

    return src.mapInArrow(run, "g long, s long, w long, n int, bytes binary")


def _runs_of(size: np.ndarray, limit: int):
    i = 0
    while i < len(size):
        total = np.cumsum(size[i:])
        j = i + max(1, int(np.searchsorted(total, limit, "right")))
        yield i, j
        i = j


RANGES = "g long, s long, o int, m int"


def _ranges(g, s, ptr, size, rep) -> pa.RecordBatch:
    """Runs of repeated window starts of each piece, as (g, s, first window, windows)."""
    piece = np.repeat(np.arange(len(size)), size)
    on = np.flatnonzero(rep)
    new = np.ones(len(on), dtype=bool)
    new[1:] = (on[1:] != on[:-1] + 1) | (piece[on[1:]] != piece[on[:-1]])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(on)))
    p = piece[on[first]]
    return pa.RecordBatch.from_arrays(
        [_long(g[p]), _long(s[p]), pa.array((on[first] - ptr[p]).astype(np.int32)), pa.array(count.astype(np.int32))],
        names=["g", "s", "o", "m"])


def merged_ranges(cut: DataFrame, k: int = K) -> DataFrame:
    """(g, s, o, m): repeated windows [o, o + m) of the distinct pieces (g, s, w, n, bytes), anchors whole."""
    def solve(parts):
        batch = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        data, ptr = string_bytes(batch.column(3))
        g, s, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
        return _ranges(g, s, ptr, np.diff(ptr), repeated_starts(data, ptr, w.astype(np.float64), k))

    def run(batches):
        """Blocks of whole anchors; the last anchor of a batch waits for the next batch."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            g = rows.column(0).to_numpy(zero_copy_only=False)
            _, ptr = string_bytes(rows.column(3))
            starts = np.append(np.flatnonzero(np.append(True, g[1:] != g[:-1])), len(g))
            i = 0
            while i < len(starts) - 2:  # the last anchor may go on
                j = i + 1
                while j < len(starts) - 2 and ptr[starts[j + 1]] - ptr[starts[i]] <= BLOCK:
                    j += 1
                yield solve([rows.slice(starts[i], starts[j] - starts[i])])
                i = j
            held = [rows.slice(starts[i])]
        if held:
            yield solve(held)

    src = cut.select("g", "s", "w", "bytes").repartition("g").sortWithinPartitions("g", "s")
    return src.mapInArrow(run, RANGES)


def hashed_ranges(cut: DataFrame, k: int = K) -> DataFrame:
    """The same for anchors with any number of pieces: windows one by one, by 128 bits of hash."""
    def run(batches):
        for batch in batches:
            for i, j in slices(batch.column(3), 1 << 18):
                part = batch.slice(i, j - i)
                data, ptr = string_bytes(part.column(3))
                count = np.diff(ptr) - k + 1
                piece = np.repeat(np.arange(len(part)), count)
                o = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                a = ptr[piece] + o
                take = pa.array(piece)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c).take(take) for c in range(3)], pa.array(o.astype(np.int32)),
                     _long(_span_hash(data, a, a + k, 3)), _long(_span_hash(data, a, a + k, 4))],
                    names=["g", "s", "w", "o", "e1", "e2"])

    win = cut.select("g", "s", "w", "bytes").mapInArrow(run, "g long, s long, w long, o int, e1 long, e2 long")
    again = win.groupBy("e1", "e2").agg(F.sum("w").alias("t")).where("t > 1").select("e1", "e2")
    # consecutive windows of a piece (at most 3K/5 of them) as one range: window less rank is the same in a run
    runs = (win.join(again, ["e1", "e2"], "left_semi").groupBy("g", "s").agg(F.sort_array(F.collect_set("o")).alias("all"))
               .select("g", "s", F.posexplode("all").alias("i", "o")))
    return (runs.groupBy("g", "s", (F.col("o") - F.col("i")).alias("run"))
                .agg(F.min("o").alias("o"), F.count(F.lit(1)).cast("int").alias("m")).select("g", "s", "o", "m"))


def repeated_spans(docs: DataFrame, k: int = K) -> DataFrame:
    """(d, th, a, n): byte spans to remove, n bytes from byte a; they may overlap. ``docs`` has d, th, text."""
    spark = docs.sparkSession
    found, p1 = staged(pieces(docs, k), "suffix-pieces")
    once = (found.groupBy("g", "s").agg(F.count(F.lit(1)).alias("w"), F.min(F.struct(*DOC, "a", "n")).alias("src"))
                 .select("g", "s", "w", "src.*"))
    anchor = once.groupBy("g").agg(F.sum("w").alias("t"), F.count(F.lit(1)).alias("pieces")).where("t > 1").drop("t")
    live, p2 = staged(once.join(anchor, "g"), "suffix-live")
    hot = F.col("pieces") > CAP
    cut, p3 = staged(_cut_pieces(docs, live.where(~hot), k), "suffix-cut")
    ranges, p4 = staged(merged_ranges(cut, k), "suffix-ranges")
    drop_stage(spark, p3)
    wide = live.where(hot)
    if not wide.isEmpty():
        cut, p3 = staged(_cut_pieces(docs, wide, k), "suffix-cut-hot")
        more, p5 = staged(hashed_ranges(cut, k), "suffix-ranges-hot")
        ranges = ranges.unionByName(more)
        drop_stage(spark, p3)
    drop_stage(spark, p2)
    return (found.join(ranges, ["g", "s"])
                 .select(*DOC, (F.col("a") + F.col("o")).alias("a"), (F.col("m") + (k - 1)).cast("long").alias("n")))


def remove_repeats(docs: DataFrame, k: int = K, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with ``text`` as the kept bytes (binary: a cut may fall inside a character), plus ``n_bytes``,
    ``n_removed`` and ``n_spans``."""
    if k % (5 * ROUNDS):
        raise ValueError(f"k must be a multiple of {5 * ROUNDS}")
    added = ("n_bytes", "n_removed", "n_spans")
    keep = [c for c in docs.columns if c != text and c not in added]
    base = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(keep)],
                       F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1)).alias("d"),
                       F.xxhash64(text_of(text)).alias("th"), text_of(text).alias("text"))
    text_batches(docs.sparkSession)
    spans, _ = staged(repeated_spans(base.select(*DOC, "text"), k)
                      .groupBy(*DOC).agg(F.collect_set(F.struct("a", "n")).alias("_cut")), "suffix-spans")
    c = len(keep)
    src = base.join(spans, DOC, "left").select(*[f"_c{i}" for i in range(c)], "text", "_cut")
    schema = T.StructType([*src.schema.fields[:c], T.StructField("text", T.BinaryType()),
                           *[T.StructField(x, T.LongType()) for x in added]])

    def run(batches):
        for batch in batches:
            for i, j in slices(batch.column(c)):
                part = batch.slice(i, j - i)
                data, off = string_bytes(part.column(c))
                cut = part.column(c + 1).fill_null([])
                flat = cut.flatten()
                a, n = (flat.field(f).to_numpy(zero_copy_only=False) for f in range(2))
                doc = np.repeat(np.arange(len(part)), cut.value_lengths().to_numpy(zero_copy_only=False))
                depth = np.zeros(len(data) + 1, dtype=np.int32)
                np.add.at(depth, off[doc] + a, 1)
                np.add.at(depth, off[doc] + a + n, -1)
                gone = np.cumsum(depth[:-1]) > 0
                first = gone.copy()
                first[1:] &= ~gone[:-1]
                inner = off[:-1][off[:-1] < len(data)]
                first[inner] = gone[inner]
                size = np.diff(off)
                total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[off])
                removed = total(gone)
                ends = np.concatenate(([0], np.cumsum(size - removed))).astype(np.int32)
                kept = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends), pa.py_buffer(data[~gone])])
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(x) for x in range(c)], kept, _long(size), _long(removed), _long(total(first))],
                    names=schema.names)

    out = src.mapInArrow(run, schema)
    return out.select(*[F.col(f"_c{i}").alias(name) for i, name in enumerate(keep)], F.col("text").alias(text), *added)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))
