"""Benchmark decontamination by CGK embeddings and bit-sampling LSH, verified by edit distance.

Texts and benchmark items are sequences of words (runs of ASCII digits and letters and of anything outside
ASCII, lower-cased). A document is contaminated by an item if some window of it is within
``100 - percent`` percent of the item's length in word edits.

1. Items longer than ``PIECE`` words are cut into pieces of at least half of it; a text close to a long item
   is as close to one of its pieces. One piece makes a hit; ``pieces_found`` says how many of them the document
   holds, ``total`` how long the whole item is, ``n`` how long the piece compared.
   Items under ``LEAST`` words are matched exactly (no edit): their word sequences are joined with the texts' by
   hash. Those under ``least_words`` words are left out, since so short a phrase stands in clean texts too; at 1
   none is. A text is dropped by items of ``EVIDENCE`` words or more.
2. Segments. A piece that allows k edits is cut into k // 2 + 1 segments or more, of ``SEGMENT`` words at most.
   Wherever the edits are, bunched or spread, some segment has one at most.
3. CGK. Every repetition walks over a segment of n words in 2n steps with its own random functions: at step j it
   writes the current word and moves on if the word's random bit for step j says so. An edit then costs few
   positions of the written sequence (Hamming distance) with good probability, since the walks of two texts
   soon meet again.
4. Bit sampling. ``SAMPLES`` positions of the walk are a bucket. Starts in the text meet segments of an item in one
   of ``repetitions(...)`` buckets with the target recall, computed for the worst place and kind of the edit.
5. Edit distance. Each piece and stretch of text that met, and share so many distinct words as k edits leave,
   are verified by dynamic programming over all windows of the stretch.

Two filters keep all other windows from being embedded or shuffled. A window within k edits of an item of n
words holds at least n - q + 1 - kq of the item's q-grams (q = 4, or 3 where only such are sure to survive),
so walks start only inside windows with so many q-grams of the benchmark; and only buckets that some item has are
emitted. Both are bit tables of fixed size (``BITS``), so what is broadcast does not grow; with a larger
benchmark they let more through, but never lose a window.

Defined results: null and empty texts match nothing; a null item text is no item; repeated rows give the
same rows once per (id, item); rows with a null id are reported with a null id; no table may lack rows: an
empty one gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.shared import stage, text_batches, text_of
from tagweave.llm.words import BASE, PUNCT_BYTES, U, Words, complete, mix, ngrams, slices, split_words, string_bytes

LEAST, PIECE = 8, 96
EVIDENCE = 5      # least words of an item that makes a text contaminated
SAMPLES = 2
SEGMENT = 16      # most words of a segment
MEETING = 0.20    # least chance of a common bucket with one edit at the worst place of a segment (simulated)
MEETING_SHORT = {2: 0.06, 3: 0.14}  # the same for segments of so few words, which only low percents have
ZONE = 512        # most starts of windows in one row
NEAR = 8          # starts so close that meet the same bucket are one
BITS = 24         # the bit tables have 2**BITS bits (2 MB)
GROWTH = 1.25     # of the size classes of windows
DOC = ["d", "th"]


def repetitions(target: float = 0.99, shortest: int = SEGMENT) -> int:
    """Repetitions for the target recall; ``shortest`` is the number of words of the shortest segment."""
    if shortest < 2:
        raise ValueError("percent is too low for segments of two words")
    return math.ceil(math.log(1 - target) / math.log(1 - MEETING_SHORT.get(shortest, MEETING)))


def edits(n, percent: int):
    return n * (100 - percent) // 100


def gram_size(n: int, percent: int) -> int:
    k = edits(n, percent)
    return max(1, min(4, -(-(n - k) // (k + 1))))


def least_grams(n: int, percent: int) -> int:
    k, q = edits(n, percent), gram_size(n, percent)
    return max(1, n - q + 1 - k * q)


def size_class(n):
    return np.floor(np.log(np.maximum(n, LEAST) / LEAST) / math.log(GROWTH) + 1e-9).astype(np.int64)


def segment_cuts(n: int, percent: int) -> np.ndarray:
    """Bounds of the segments of a piece: so many that one has at most one of the edits allowed."""
    parts = max(edits(n, percent) // 2 + 1, -(-n // SEGMENT))
    return np.arange(parts + 1) * n // parts


def segment_sizes(sizes: list[int], percent: int) -> list[int]:
    return sorted({int(x) for n in sizes for x in np.diff(segment_cuts(n, percent))})


def _word_arrays(column: pa.Array) -> Words:
    return split_words(*string_bytes(column), separators=PUNCT_BYTES)


def item_pieces(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, piece, n, words, total) of the items; ``total`` words are in all pieces of one."""
    def run(batches):
        for batch in batches:
            w = _word_arrays(batch.column(1))
            rows = ([], [], [], [], [])
            for d, n in enumerate(w.counts.tolist()):
                parts = -(-n // PIECE)
                cut = w.ptr[d] + np.arange(parts + 1) * n // parts
                for p in range(parts):
                    rows[0].append(d)
                    rows[1].append(p)
                    rows[2].append(int(cut[p + 1] - cut[p]))
                    rows[3].append(w.hash[cut[p]:cut[p + 1]].view(np.int64))
                    rows[4].append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows[0], type=pa.int64())), pa.array(rows[1], type=pa.int32()),
                 pa.array(rows[2], type=pa.int64()), pa.array(rows[3], type=pa.list_(pa.int64())),
                 pa.array(rows[4], type=pa.int64())],
                names=["item", "piece", "n", "words", "total"])

    src = benchmark.select(F.col(item).cast("long").alias("item"), F.lower(text_of(text)).alias("_text"))
    return src.mapInArrow(run, "item long, piece int, n long, words array<long>, total long")


def _flat(lists) -> tuple[np.ndarray, np.ndarray]:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    off = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy()[off[0]:off[-1]].view(U), off - off[0]


def gram_hashes(hashes: np.ndarray, q: int) -> np.ndarray:
    w = Words(None, None, None, None, np.array([0, len(hashes)]), hashes)
    return mix(ngrams(w, q) + U(q))


def _spots(r: int, sizes: list[int]) -> dict[int, np.ndarray]:
    """Sampled walk positions of a repetition: they depend on it and the size alone, so items and texts agree."""
    return {c: np.sort(np.random.default_rng([r, c]).integers(0, 2 * c, SAMPLES)) for c in sizes}


def walk_buckets(hashes: np.ndarray, start: np.ndarray, end: np.ndarray, sizes: list[int], reps: int):
    """CGK walks from ``start`` (words; ``end`` is where each one's text ends): for each repetition and size of
    segments yields (repetition, size, bucket of each start)."""
    for r in range(reps):
        spots = _spots(r, sizes)
        last = max(int(x[-1]) for x in spots.values())
        salts = np.array([(r * 1_000_003 + b * 7919 + 1) * BASE % (1 << 64) for b in range(last // 64 + 1)], dtype=U)
        bits = [mix(hashes ^ s) for s in salts]  # bit j of word i: whether step j moves on at it
        at = start.copy()
        seen = {c: np.full(len(start), (r * 64 + c + 1) * 0x9E3779B1, dtype=U) for c in sizes}
        for j in range(last + 1):
            inside = at < end
            here = np.minimum(at, len(hashes) - 1)
            asked = [c for c in sizes if j in spots[c]]
            if asked:
                word = np.where(inside, hashes[here], U(0))
                for c in asked:
                    for _ in range(int((spots[c] == j).sum())):
                        seen[c] = mix(seen[c] * U(31) + word)
            at += inside & ((bits[j // 64][here] >> U(j % 64)) & U(1)).astype(bool)
        for c in sizes:
            yield r, c, seen[c]


def bit_table(hashes: DataFrame) -> np.ndarray:
    """The bit table of a column ``h`` of hashes: 2**BITS bits, whatever the number of rows."""
    slot = F.shiftrightunsigned("h", 64 - BITS)
    rows = (hashes.groupBy(F.shiftright(slot, 6).alias("i"))
                  .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))).alias("m"))
                  .collect())
    table = np.zeros(1 << (BITS - 6), dtype=U)
    for r in rows:
        table[r["i"]] = np.int64(r["m"]).view(U)
    return table


def _in_table(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = (h >> U(64 - BITS)).astype(np.int64)
    return ((table[slot >> 6] >> (slot & 63).astype(U)) & U(1)).astype(bool)


def piece_keys(pieces: DataFrame, percent: int, reps: int) -> DataFrame:
    """(item, piece, n, kind, off, h): kind 0 are q-gram hashes, kind 1 LSH buckets of the segment from word ``off``."""
    def run(batches):
        for batch in batches:
            vals, base = _flat(batch.column(3))
            n = batch.column(2).to_numpy()
            row, kind, off, out = [], [], [], []
            part, at, size = [], [], []  # of each segment
            for i, words in enumerate(n.tolist()):
                g = gram_hashes(vals[base[i]:base[i + 1]], gram_size(words, percent))
                g = g[:words - gram_size(words, percent) + 1]
                row.append(np.full(len(g), i))
                kind.append(np.zeros(len(g), dtype=np.int32))
                off.append(np.zeros(len(g), dtype=np.int64))
                out.append(g)
                cut = segment_cuts(words, percent)
                part.append(np.full(len(cut) - 1, i))
                at.append(cut[:-1])
                size.append(np.diff(cut))
            if not row:
                continue
            part, at, size = (np.concatenate(x) for x in (part, at, size))
            for c in np.unique(size).tolist():
                idx = np.flatnonzero(size == c)
                first = base[part[idx]] + at[idx]
                # to the end of the piece: a walk past the segment reads on, as it does in a text
                for _, _, b in walk_buckets(vals, first, base[part[idx] + 1], [c], reps):
                    row.append(part[idx])
                    kind.append(np.ones(len(idx), dtype=np.int32))
                    off.append(at[idx])
                    out.append(b)
            row, kind, off, out = (np.concatenate(x) for x in (row, kind, off, out))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take),
                 pa.array(kind.astype(np.int32)), pa.array(off), pa.array(out.astype(U).view(np.int64))],
                names=["item", "piece", "n", "kind", "off", "h"])

    return pieces.mapInArrow(run, "item long, piece int, n long, kind int, off long, h long")


def short_keys(pieces: DataFrame) -> DataFrame:
    """(item, n, h): the hash of the whole word sequence of each (short) item."""
    def run(batches):
        for batch in batches:
            vals, base = _flat(batch.column(2))
            n = batch.column(1).to_numpy()
            h = [gram_hashes(vals[base[i]:base[i + 1]], int(q))[0] for i, q in enumerate(n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(h, dtype=U).view(np.int64))],
                                             names=["item", "n", "h"])

    return pieces.select("item", "n", "words").mapInArrow(run, "item long, n long, h long")


def find_phrases(docs: DataFrame, table: np.ndarray, sizes: list[int]) -> DataFrame:
    """(d, th, n, h, first_word): the first place of each phrase of ``sizes`` words in ``docs`` that ``table`` lets by."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            for i, j in slices(batch.column(2)):
                part = batch.slice(i, j - i)
                w = _word_arrays(part.column(2))
                doc = w.doc()
                for q in sizes:
                    h = mix(ngrams(w, q) + U(q))
                    at = np.flatnonzero(complete(w, q) & _in_table(shared.value, h))
                    at = at[np.lexsort((at, h[at], doc[at]))]
                    one = np.ones(len(at), dtype=bool)
                    one[1:] = (h[at[1:]] != h[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])
                    at = at[one]
                    take = pa.array(doc[at])
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(take), part.column(1).take(take), pa.array(np.full(len(at), q)),
                         pa.array(h[at].view(np.int64)), pa.array(at - w.ptr[doc[at]])],
                        names=[*DOC, "n", "h", "first_word"])

    return docs.select(*DOC, F.lower(text_of()).alias("_text")).mapInArrow(
        run, "d long, th long, n long, h long, first_word long")


def quoted(docs: DataFrame, pieces: DataFrame, sizes: list[int]) -> DataFrame:
    """The rows of ``contaminated`` for items under ``LEAST`` words, which match word for word."""
    keys = stage(short_keys(pieces).distinct(), "bench-phrases")
    hits = find_phrases(docs, bit_table(keys.select("h").distinct()), sizes).join(keys, ["n", "h"])
    return (hits.groupBy(*DOC, "item").agg(F.min(F.struct(-F.col("n"), "first_word", "n")).alias("m"))
                .select(*DOC, "item", F.lit(0).cast("long").alias("edits"), "m.n", "m.first_word",
                        F.col("m.n").alias("n_words"), F.col("m.n").alias("total"), F.lit(1).cast("long").alias("pieces_found")))


def find_windows(docs: DataFrame, grams: np.ndarray, buckets: np.ndarray, sizes: list[int], percent: int, reps: int):
    """(d, th, z, starts, keys, words): zones of ``docs`` (d, th, text) with starts in a bucket of some segment.
    ``words`` are the document's from word ``z`` on, ``starts`` (from z) and ``keys`` the buckets of the starts.
    ``sizes`` are the distinct numbers of words of the pieces (at most PIECE)."""
    segments = segment_sizes(sizes, percent)
    classes = sorted({int(size_class(n)) for n in sizes})
    need = {c: min(least_grams(n, percent) for n in sizes if size_class(n) == c) for c in classes}
    reach = {c: max(n + edits(n, percent) for n in sizes if size_class(n) == c) for c in classes}
    longest = max(reach.values())
    qs = sorted({gram_size(n, percent) for n in sizes})
    shared = docs.sparkSession.sparkContext.broadcast((grams, buckets))

    def run(batches):
        gram_bits, bucket_bits = shared.value
        for batch in batches:
            for i, j in slices(batch.column(2)):
                part = batch.slice(i, j - i)
                w = _word_arrays(part.column(2))
                n = len(w.hash)
                hit = np.zeros(n, dtype=bool)
                for q in qs:
                    ok = np.flatnonzero(complete(w, q))
                    hit[ok] |= _in_table(gram_bits, mix(ngrams(w, q) + U(q))[ok])
                near = np.flatnonzero(hit)
                if not len(near):
                    continue
                count = np.concatenate(([0], np.cumsum(hit)))
                end = np.repeat(w.ptr[1:], w.counts)
                # starts that can hold a hit: up to the longest window before one
                zone = np.zeros(n + 1, dtype=np.int64)
                np.add.at(zone, np.maximum(near - longest, 0), 1)
                np.add.at(zone, near + 1, -1)
                start = np.flatnonzero(np.cumsum(zone[:-1]) > 0)
                # walks start anywhere in a window that passes
                inner = np.zeros(n + 1, dtype=np.int64)
                for c in classes:
                    stop = np.minimum(start + reach[c], end[start])
                    ok = count[stop] - count[start] >= need[c]
                    np.add.at(inner, start[ok], 1)
                    np.add.at(inner, stop[ok], -1)
                start = np.flatnonzero(np.cumsum(inner[:-1]) > 0)
                if not len(start):
                    continue
                rows, keys = [], []
                for _, _, b in walk_buckets(w.hash, start, end[start], segments, reps):
                    ok = np.flatnonzero(_in_table(bucket_bits, b))
                    rows.append(start[ok])
                    keys.append(b[ok])
                at, keys = np.concatenate(rows), np.concatenate(keys)
                if not len(at):
                    continue
                order = np.lexsort((at, keys))
                at, keys = at[order], keys[order]
                doc = np.searchsorted(w.ptr, at, "right") - 1
                close = (at - w.ptr[doc]) // NEAR
                one = np.concatenate(([True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1]) | (close[1:] != close[:-1])))
                at, keys = at[one], keys[one]
                order = np.argsort(at, kind="stable")
                at, keys = at[order], keys[order]
                # zones: starts of a document close to each other, at most ZONE words apart
                doc = np.searchsorted(w.ptr, at, "right") - 1
                part_of = (at - w.ptr[doc]) // ZONE
                cut = np.concatenate(([True], (part_of[1:] != part_of[:-1]) | (doc[1:] != doc[:-1])))
                first = np.flatnonzero(cut)
                last = np.append(first[1:], len(at)) - 1
                # with the words before and after that a window around a segment can hold
                lo, hi = np.maximum(at[first] - longest, w.ptr[doc[first]]), np.minimum(at[last] + longest + NEAR, end[at[last]])
                off = np.concatenate(([0], np.cumsum(hi - lo)))
                words = w.hash[np.arange(off[-1]) + np.repeat(lo - off[:-1], hi - lo)]
                take = pa.array(doc[first])
                cuts = pa.array(np.append(first, len(at)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), pa.array(lo - w.ptr[doc[first]]),
                     pa.ListArray.from_arrays(cuts, pa.array((at - np.repeat(lo, last - first + 1)).astype(np.int32))),
                     pa.ListArray.from_arrays(cuts, pa.array(keys.view(np.int64))),
                     pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(words.view(np.int64)))],
                    names=[*DOC, "z", "starts", "keys", "words"])

    return docs.select(*DOC, F.lower(text_of()).alias("_text")).mapInArrow(
        run, "d long, th long, z long, starts array<int>, keys array<long>, words array<long>")


def window_distance(items: np.ndarray, item_n: np.ndarray, texts: np.ndarray, text_n: np.ndarray, free: bool = True):
    """(edit distance, first word, length) of the window of each text closest to its item, the first and
    shortest of equals; rows padded with zeros. Windows start at word 0 if not ``free``."""
    rows, width = texts.shape
    edit = np.int64(1 << 32)  # cells are edits * 2**32 + first word
    col = np.arange(width + 1) * edit
    prev = np.tile(np.arange(width + 1) if free else col, (rows, 1))
    never = np.int64(1 << 62)
    best, length = np.full(rows, never), np.zeros(rows, dtype=np.int64)
    usable = np.arange(width + 1)[None, :] <= text_n[:, None]
    for i in range(items.shape[1]):
        cur = np.empty_like(prev)
        cur[:, 0] = (i + 1) * edit
        cur[:, 1:] = np.minimum(prev[:, :-1] + (texts != items[:, i:i + 1]) * edit, prev[:, 1:] + edit)
        prev = np.minimum.accumulate(cur - col, axis=1) + col  # insertions
        done = np.flatnonzero(item_n == i + 1)
        if len(done):
            d = np.where(usable[done], prev[done], never)
            length[done] = d.argmin(axis=1)
            best[done] = d.min(axis=1)
    first = best % edit
    return best // edit, first, length - first


def prefix_distance(items: np.ndarray, item_n: np.ndarray, windows: np.ndarray, window_n: np.ndarray):
    """(edit distance, length) of the prefix of each window closest to its item; rows padded with zeros."""
    dist, _, length = window_distance(items, item_n, windows, window_n, free=False)
    return dist, length


def _pad(vals: np.ndarray, off: np.ndarray) -> np.ndarray:
    n = np.diff(off)
    out = np.zeros((len(n), max(int(n.max(initial=0)), 1)), dtype=U)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(vals)) - np.repeat(off[:-1], n)] = vals
    return out


def verify(pairs: DataFrame, percent: int) -> DataFrame:
    """(d, th, item, piece, edits, n, first_word, n_words, total) of the pairs close enough."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                iv, io = _flat(part.column(6))
                wv, wo = _flat(part.column(5))
                n = np.diff(io)
                dist, first, length = window_distance(_pad(iv, io), n, _pad(wv, wo), np.diff(wo))
                ok = pa.array(np.flatnonzero(dist <= edits(n, percent)))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c).take(ok) for c in range(4)], pa.array(dist.astype(np.int64)).take(ok),
                     pa.array(n).take(ok), pa.array(part.column(4).to_numpy() + first).take(ok), pa.array(length).take(ok),
                     part.column(7).take(ok)],
                    names=[*DOC, "item", "piece", "edits", "n", "first_word", "n_words", "total"])

    cols = [*DOC, "item", "piece", "s", "window", "words", "total"]
    return pairs.select(*cols).mapInArrow(
        run, "d long, th long, item long, piece int, edits long, n long, first_word long, n_words long, total long")


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with d (the id, null last) and th (the text's hash)."""
    return docs.withColumns({"d": F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1)),
                             "th": F.xxhash64(text_of(text))})


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80, target: float = 0.99,
                 key: str = "doc_id", text: str = "text", least_words: int = EVIDENCE) -> DataFrame:
    """(d, th, item, edits, n, first_word, n_words, total, pieces_found): the closest window for each document and
    item of ``least_words`` words or more."""
    text_batches(docs.sparkSession)
    pieces = stage(item_pieces(benchmark).where(F.col("total") >= least_words)
                   .withColumn("own", F.array_distinct("words")), "bench-pieces")
    sizes = [r[0] for r in pieces.select("n").distinct().collect()]  # at most PIECE values
    base = keyed(docs, key, text).select(*DOC, F.col(text).alias("text"))
    short, long = [n for n in sizes if n < LEAST], [n for n in sizes if n >= LEAST]
    found = []
    if short:
        found.append(quoted(base, pieces.where(F.col("n") < LEAST), short))
    if long:
        found.append(_close(base, pieces.where(F.col("n") >= LEAST), long, percent, target))
    if not found:
        return base.select(*DOC, *[F.lit(0).cast("long").alias(c) for c in
                                   ("item", "edits", "n", "first_word", "n_words", "total", "pieces_found")]).where(F.lit(False))
    if len(found) == 1:
        return found[0]
    # an item id that is repeated with another text may be in both
    both = found[0].unionByName(found[1])
    return (both.groupBy(*DOC, "item").agg(F.min(F.struct("edits", -F.col("n"), "first_word", "n", "n_words", "total")).alias("m"),
                                           F.max("pieces_found").alias("pieces_found"))
                .select(*DOC, "item", "m.edits", "m.n", "m.first_word", "m.n_words", "m.total", "pieces_found"))


def _close(base: DataFrame, pieces: DataFrame, sizes: list[int], percent: int, target: float) -> DataFrame:
    """The rows of ``contaminated`` for items of ``LEAST`` words or more, which match within their edits."""
    reps = repetitions(target, segment_sizes(sizes, percent)[0])
    keys = stage(piece_keys(pieces, percent, reps), "bench-keys")
    tables = [bit_table(keys.where(F.col("kind") == k).select("h").distinct()) for k in (0, 1)]
    found = stage(find_windows(base, *tables, sizes, percent, reps).dropDuplicates([*DOC, "z"]), "bench-windows")
    met = (found.select(*DOC, "z", F.explode(F.arrays_zip("starts", "keys")).alias("x"))
                .select(*DOC, "z", F.col("x.starts").alias("o"), F.col("x.keys").alias("h"))
                .join(keys.where(F.col("kind") == 1).select("h", "item", "piece", "n", "off"), "h")
                # where in the zone the piece would begin, in steps of its length
                .select(*DOC, "z", "item", "piece", F.floor((F.col("o") - F.col("off")) / F.col("n")).alias("b")).distinct())
    k = F.floor(F.col("n") * (100 - percent) / 100)
    lo = F.greatest(F.lit(0).cast("long"), F.col("b") * F.col("n") - k)
    hi = (F.col("b") + 2) * F.col("n") + k + NEAR
    pairs = (met.join(found.select(*DOC, "z", F.col("words").alias("zone")), [*DOC, "z"])
                .join(pieces.select("item", "piece", "n", "words", "own", "total"), ["item", "piece"])
                .withColumn("window", F.slice("zone", (lo + 1).cast("int"), (hi - lo).cast("int")))
                .withColumn("s", F.col("z") + lo))
    # an edit takes away one distinct word of the item at most
    pairs = pairs.where(F.size(F.array_intersect("own", "window")) >= F.size("own") - k)
    close = verify(pairs, percent)
    best = close.groupBy(*DOC, "item").agg(F.min(F.struct("edits", "first_word", "n_words", "n", "total")).alias("m"),
                                           F.count_distinct("piece").alias("pieces_found"))
    return best.select(*DOC, "item", "m.edits", "m.n", "m.first_word", "m.n_words", "m.total", "pieces_found")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """``docs`` without the contaminated documents."""
    bad = stage(contaminated(docs, benchmark, **params).select(*DOC).distinct(), "bench-hits")
    names = docs.columns
    inner = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    out = keyed(inner, f"_c{names.index('doc_id')}", f"_c{names.index('text')}").join(bad, DOC, "left_anti")
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = contaminated(docs, items, least_words=1)
    return hits.select(F.when(F.col("d") < 2**63 - 1, F.col("d")).alias("doc_id"), F.col("item").alias("item_id"),
                       "edits", F.col("total").alias("item_words"),
                       (1 - F.col("edits") / F.col("n")).alias("similarity"), "first_word", "n_words",
                       F.col("n").alias("piece_words"), F.ceil(F.col("total") / PIECE).alias("n_pieces"), "pieces_found",
                       (F.col("total") >= EVIDENCE).alias("evidence"))
