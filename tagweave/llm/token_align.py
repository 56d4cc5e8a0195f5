"""Alignment of two tokenizers: groups of tokens, linked token pairs, and corpus-wide pair counts by perfect hash.

A text is encoded twice, by a byte-level BPE vocabulary (A) and by a piece model (B), both over the same bytes (a
space and the text). Where tokens of both end at the same byte the text is cut into groups; the tokens of A and B
in one group are linked. A pair (A id, B id) counts the documents that hold it linked.

1. Texts are encoded once; the ids are staged as two bytes each. Groups and links are derived from them again in
   every later pass by cumulative token lengths, without the tokenizers.
2. The distinct pairs of all documents get a minimal perfect hash: pairs are dealt to buckets by hash, each bucket
   (about ``BUCKET`` pairs) is hashed level by level into bit arrays where a bit is set if one pair alone falls on
   it, and a pair's index is the rank of its bit. The pairs are kept in index order, so every lookup is verified.
3. Counts are dense vectors under the index. A task adds the pairs of its documents to its own vector, cut into
   blocks, and the blocks of all tasks are summed in a tree of ``FAN`` at a time. A pair in every document is one
   number of a vector, not a hot key.
4. The second pass aligns the documents again and looks up the counts of their links.

Hash and counts of at most ``STRIPE`` pairs (about 60 MB) are sent to the executors at once, whatever the corpus:
more pairs are worked off in stripes of buckets, a pass over the ids for each. What is kept for a vocabulary (its
tokens, the highest count of each A id) is bounded by the vocabulary.

Defined results: null and empty texts, and texts whose tokens do not give back their bytes in either vocabulary,
have no tokens (zeros, empty ``groups``); rows with equal or null ids are separate documents; an empty table gives
an empty result; extra columns stay, added columns replace those of the same name. The files of the vocabularies
are read by the driver and sent along (2 MB).
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.llm.shared import stage, staged, text_batches, text_of
from tagweave.llm.words import U, mix, slices, string_bytes

STRIPE = 1 << 22
BUCKET = 2048
BLOCK = 1 << 16   # counts in a block of a vector
FAN = 32
SMALL = 4096      # links of a group that are listed at once


def vocabulary_paths() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# ---------------------------------------------------------------------------
# vocabularies


def _byte_chars() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = sorted(set(range(256)) - set(keep))
    return {chr(c): b for c, b in zip([*keep, *range(256, 256 + len(rest))], [*keep, *rest])}


class Table:
    """Bytes of the tokens of a vocabulary, by id."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        stop = np.cumsum(size)
        return self.data[np.arange(stop[-1] if len(stop) else 0) + np.repeat(self.start[ids] - (stop - size), size)]


def byte_table(spec: bytes) -> Table:
    vocab, chars = json.loads(spec)["model"]["vocab"], _byte_chars()
    tokens = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        tokens[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else b""
    return Table(tokens)


def piece_table(model) -> Table:
    out = []
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            out.append(bytes([int(model.id_to_piece(i)[1:-1], 16)]))
        else:
            out.append(b"" if model.is_control(i) else model.id_to_piece(i).replace("▁", " ").encode())
    return Table(out)


#: Fixed value: how byte-level vocabularies of this family cut text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLANKS = re.compile(r"\s{10000}")   # runs that the rank encoder's pattern search has no stack for


def rank_encoder(spec: bytes):
    """An encoder that merges by rank, over twice as fast as by the list of merges; None unless it must give the
    same ids: the merges have to be in the order of the ids they make, and the text has to be cut by ``PATTERN``."""
    import tiktoken
    told = json.loads(spec)
    vocab, merges, cut = told["model"]["vocab"], told["model"]["merges"], told["pre_tokenizer"] or {}
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
    plain = told["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut["add_prefix_space"]
    if not plain or made != sorted(set(made)) or told["model"].get("ignore_merges"):
        return None
    chars, special = _byte_chars(), {t["content"] for t in told["added_tokens"]}
    ranks = {bytes(chars[c] for c in t): i for t, i in vocab.items() if t not in special}
    return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoders:
    """Both tokenizers; made once in each Python worker."""

    kept: dict = {}

    def __init__(self, spec: bytes, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_buffer(spec)
        self.a.encode_special_tokens = True
        self.ranked = rank_encoder(spec)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.tables = byte_table(spec), piece_table(self.b)

    @classmethod
    def of(cls, spec: bytes, model: bytes) -> Encoders:
        key = hash((spec, model))
        if key not in cls.kept:
            cls.kept = {key: cls(spec, model)}
        return cls.kept[key]

    def byte_ids(self, text: str) -> np.ndarray:
        if self.ranked is None or len(text) > 10_000 and BLANKS.search(text):
            return np.array(self.a.encode(text, add_special_tokens=False).ids, dtype=np.uint16)
        return self.ranked.encode_to_numpy(text, disallowed_special=()).astype(np.uint16)

    def encode(self, texts: list[str]) -> list[list[np.ndarray]]:
        """Ids of each text under A and B; no ids where the bytes differ from a space and the text."""
        a = [self.byte_ids(" " + t) for t in texts]
        b = [np.array(x, dtype=np.uint16) for x in self.b.encode(texts, num_threads=1)]
        none = np.zeros(0, dtype=np.uint16)
        for i, t in enumerate(texts):
            want = np.frombuffer((" " + t).encode(), dtype=np.uint8)
            if not t or not all(np.array_equal(table.spell(x[i]), want) for table, x in zip(self.tables, (a, b))):
                a[i] = b[i] = none
        return [a, b]


def _binary(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([x.nbytes for x in arrays]))).astype(np.int32)
    data = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.uint16)
    return pa.Array.from_buffers(pa.binary(), len(arrays), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, off = string_bytes(column)
    return np.ascontiguousarray(data).view(np.uint16), off // 2


# ---------------------------------------------------------------------------
# groups and links


class Groups:
    """Groups of a run of documents, from ids (a, b) and the tokens' sizes."""

    def __init__(self, a, a_ptr, b, b_ptr, tables):
        self.a, self.b, self.docs = a.astype(np.int64), b.astype(np.int64), len(a_ptr) - 1
        end_a, end_b = np.cumsum(tables[0].size[self.a]), np.cumsum(tables[1].size[self.b])
        ends = np.zeros(int(end_a[-1]) + 1 if len(end_a) else 1, dtype=np.int8)
        ends[end_a] += 1   # all documents have equal bytes under both, so their ends coincide
        ends[end_b] += 1
        cut = ends == 2
        before = np.cumsum(cut, dtype=np.int32) - cut   # cuts before each byte: the group of a token by its end
        self.n = int(cut.sum())
        self.na, self.nb = (np.bincount(before[e], minlength=self.n) for e in (end_a, end_b))
        self.a0, self.b0 = np.cumsum(self.na) - self.na, np.cumsum(self.nb) - self.nb
        self.doc = np.repeat(np.arange(self.docs), np.diff(a_ptr))[self.a0] if self.n else np.zeros(0, dtype=np.int64)
        self.a_ptr, self.b_ptr = a_ptr, b_ptr

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.docs, dtype=np.int64)
        np.add.at(out, self.doc, values)
        return out

    def _listed(self, g: np.ndarray, width: int) -> np.ndarray:
        """The links of the groups ``g``, one by one, as pair * documents + document."""
        links = self.na[g] * self.nb[g]
        at = np.arange(links.sum()) - np.repeat(np.cumsum(links) - links, links)
        nb = np.repeat(self.nb[g], links)
        pair = self.a[np.repeat(self.a0[g], links) + at // nb] * width + self.b[np.repeat(self.b0[g], links) + at % nb]
        return pair * self.docs + np.repeat(self.doc[g], links)

    def _crossed(self, g: int, width: int):
        """(pair * documents + document, links) of one large group: distinct ids and how often they stand."""
        ua, ca = np.unique(self.a[self.a0[g]:self.a0[g] + self.na[g]], return_counts=True)
        ub, cb = np.unique(self.b[self.b0[g]:self.b0[g] + self.nb[g]], return_counts=True)
        pair = (ua[:, None] * width + ub[None, :]).ravel()
        return pair * self.docs + self.doc[g], (ca[:, None] * cb[None, :]).ravel()

    def pairs(self, width: int) -> DocPairs:
        """Distinct pairs of the documents; pair = A id * width + B id."""
        links = self.na * self.nb
        found, small = [], np.flatnonzero(links <= SMALL)
        total = np.cumsum(links[small])
        i = 0
        while i < len(small):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + (1 << 20), "right")))
            found.append(_runs(np.sort(self._listed(small[i:j], width))))
            i = j
        found += [self._crossed(int(g), width) for g in np.flatnonzero(links > SMALL)]
        if len(found) > 1:
            key, links = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(key)
            key, links = key[order], links[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            found = [(key[first], np.add.reduceat(links, first))]
        key, links = found[0] if found else (np.zeros(0, dtype=np.int64),) * 2
        return DocPairs(key // max(self.docs, 1), key % max(self.docs, 1), links)

    def spelled(self) -> pa.Array:
        """``a1,a2|b1;a3|b2`` of each document."""
        def sides(ids, n):
            text = pc.cast(pa.array(ids.astype(np.int32)), pa.string())
            ends = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
            return pc.binary_join(pa.ListArray.from_arrays(ends, text), ",")
        groups = pc.binary_join_element_wise(sides(self.a, self.na), sides(self.b, self.nb), "|")
        ends = np.concatenate(([0], np.cumsum(np.bincount(self.doc, minlength=self.docs)))).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), groups), ";")


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often they stand."""
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
    return key[first], np.diff(np.append(first, len(key)))


class DocPairs:
    """Rows (pair, document, links) in the order of pairs; ``distinct`` pairs and the documents of each."""

    def __init__(self, pair: np.ndarray, doc: np.ndarray, links: np.ndarray):
        self.doc, self.links = doc, links
        self.distinct, self.documents = _runs(pair)

    def spread(self, values: np.ndarray) -> np.ndarray:
        """Values of the distinct pairs, for each row."""
        return np.repeat(values, self.documents)


# ---------------------------------------------------------------------------
# minimal perfect hash


def _hash(pair: np.ndarray, seed: int) -> np.ndarray:
    return mix(pair.astype(U) * U(0x9E3779B97F4A7C15) + mix(np.array([seed + 1], dtype=U)))


def bucket_of(pair: np.ndarray, buckets: int) -> np.ndarray:
    return ((_hash(pair, 0) >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def hash_bucket(pairs: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(bits of each level, all bits, pairs in index order) of one bucket's distinct pairs."""
    sizes, bits, order = [], [], []
    rest = pairs
    while len(rest):
        size = max(8, 2 * len(rest))
        at = (_hash(rest, len(sizes) + 1) % U(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        hit = alone[at]
        sizes.append(size)
        bits.append(alone)
        order.append(rest[hit][np.argsort(at[hit])])
        rest = rest[~hit]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, dtype=bool), np.concatenate(order) if order else rest


class PairHash:
    """Minimal perfect hash of the pairs of the buckets [lo, hi) of ``buckets``, with the pairs to verify."""

    def __init__(self, rows, lo: int, hi: int, buckets: int):
        """rows: (bucket, level sizes, packed bits, pairs) in the order of buckets."""
        self.lo, self.hi, self.buckets = lo, hi, buckets
        levels = np.zeros(hi - lo, dtype=np.int64)
        for r in rows:
            levels[r[0] - lo] = len(r[1])
        self.level0 = np.concatenate(([0], np.cumsum(levels)))
        self.size = np.array([s for r in rows for s in r[1]] or [1], dtype=np.int64)
        self.bit0 = np.cumsum(self.size) - self.size
        bits = [np.unpackbits(np.frombuffer(r[2], dtype=np.uint8), count=sum(r[1])) for r in rows]
        bits = np.concatenate([*bits, np.zeros(64, dtype=np.uint8)])
        packed = np.packbits(bits[:len(bits) // 64 * 64], bitorder="little").view(np.uint64)
        tail = np.zeros(64, dtype=np.uint8)
        tail[:len(bits) % 64] = bits[len(bits) // 64 * 64:]
        self.words = np.concatenate((packed, np.packbits(tail, bitorder="little").view(np.uint64)))
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.rank = np.cumsum(ones) - ones
        self.pairs = np.concatenate([np.frombuffer(r[3], dtype=np.int64) for r in rows] or [np.zeros(0, dtype=np.int64)])

    def index(self, pair: np.ndarray) -> np.ndarray:
        """Index of each pair; -1 for pairs of other stripes. A pair of this stripe that is not in it raises."""
        bucket = bucket_of(pair, self.buckets) - self.lo
        out = np.full(len(pair), -1, dtype=np.int64)
        left = np.flatnonzero((bucket >= 0) & (bucket < self.hi - self.lo))
        level = 0
        while len(left):
            at = self.level0[bucket[left]] + level
            if (at >= self.level0[bucket[left] + 1]).any():
                raise KeyError("a pair is not in the table")
            bit = self.bit0[at] + (_hash(pair[left], level + 1) % self.size[at].astype(U)).astype(np.int64)
            word, shift = self.words[bit >> 6], (bit & 63).astype(U)
            hit = ((word >> shift) & U(1)).astype(bool)
            below = np.bitwise_count(word & ((U(1) << shift) - U(1)))
            out[left[hit]] = (self.rank[bit >> 6] + below)[hit]
            left = left[~hit]
            level += 1
        own = out >= 0
        if (self.pairs[out[own]] != pair[own]).any():
            raise KeyError("a pair is not in the table")
        return out


def hash_buckets(pairs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, sizes, bits, pairs) of the distinct ``pairs`` (pair long): the hash, one row per bucket."""
    def deal(batches):
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(x, buckets)), batch.column(0)], names=["bucket", "pair"])

    def solve(key, frame):
        sizes, bits, order = hash_bucket(np.sort(frame["pair"].to_numpy()))
        return pd.DataFrame({"bucket": [key[0]], "sizes": [sizes], "bits": [np.packbits(bits).tobytes()],
                             "pairs": [order.astype(np.int64).tobytes()]})

    dealt = pairs.mapInArrow(deal, "bucket long, pair long")
    return dealt.groupBy("bucket").applyInPandas(solve, "bucket long, sizes array<long>, bits binary, pairs binary")


# ---------------------------------------------------------------------------
# passes


def encode_texts(docs: DataFrame, text: str, paths: tuple[str, str]) -> DataFrame:
    """``docs`` without the text, with its ids as binary columns ``_a`` and ``_b``."""
    files = docs.sparkSession.sparkContext.broadcast(tuple(open(p, "rb").read() for p in paths))
    keep = [c for c in docs.columns if c != text]
    src = docs.select(*keep, text_of(text).alias("_text"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("_a", T.BinaryType()), T.StructField("_b", T.BinaryType())])

    def run(batches):
        enc = Encoders.of(*files.value)
        for batch in batches:
            for i, j in slices(batch.column(len(keep))):
                part = batch.slice(i, j - i)
                a, b = enc.encode(part.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in range(len(keep))], _binary(a), _binary(b)],
                                                 names=schema.names)

    return src.mapInArrow(run, schema)


def _grouped(batch: pa.RecordBatch, tables):
    """Groups of slices of a batch whose last two columns are the ids."""
    n = batch.num_columns
    for i, j in slices(batch.column(n - 1)):
        part = batch.slice(i, j - i)
        yield part, Groups(*_ids(part.column(n - 2)), *_ids(part.column(n - 1)), tables)


def pair_counts(ids: DataFrame, stripe: PairHash, tables, width: int) -> DataFrame:
    """Documents of each pair of the stripe: dense vectors of the tasks in blocks, summed in a tree."""
    spark = ids.sparkSession
    total = len(stripe.pairs)
    shared = spark.sparkContext.broadcast((stripe, tables))

    def run(batches):
        hashed, tabs = shared.value
        vector = np.zeros(total, dtype=np.int64)
        for batch in batches:
            for _, g in _grouped(batch, tabs):
                found = g.pairs(width)
                at = hashed.index(found.distinct)
                vector[at[at >= 0]] += found.documents[at >= 0]
        part = TaskContext.get().partitionId()
        for k in range(0, total, BLOCK):
            x = vector[k:k + BLOCK]
            if x.any():
                yield _block_row(k // BLOCK, part, x)

    schema = "block long, part long, width int, counts binary"

    def add(key, frame):
        size = min(BLOCK, total - key[0] * BLOCK)
        x = np.zeros(size, dtype=np.int64)
        for w, c in zip(frame["width"], frame["counts"]):
            x += np.frombuffer(c, dtype=f"u{w}").astype(np.int64)
        return pd.DataFrame({"block": [key[0]], "part": [key[1]], "width": [8], "counts": [x.tobytes()]})

    sums = stage(ids.select("_a", "_b").mapInArrow(run, schema), "align-counts")
    while not sums.isEmpty() and sums.groupBy("block").count().agg(F.max("count")).first()[0] > 1:
        sums = stage(sums.groupBy("block", F.floor(F.col("part") / FAN).alias("part")).applyInPandas(add, schema),
                     "align-counts")
    shared.destroy()
    return sums


def dense(sums: DataFrame, total: int) -> np.ndarray:
    """The summed vector of one stripe."""
    out = np.zeros(total, dtype=np.int64)
    for r in sums.toLocalIterator():
        out[r.block * BLOCK:r.block * BLOCK + BLOCK] = np.frombuffer(bytes(r.counts), dtype=f"u{r.width}")
    return out


def _block_row(block: int, part: int, x: np.ndarray) -> pa.RecordBatch:
    width = next(w for w in (1, 2, 4, 8) if x.max() < 1 << 8 * w)
    return pa.RecordBatch.from_arrays(
        [pa.array([block]), pa.array([part]), pa.array([width], pa.int32()), pa.array([x.astype(f"u{width}").tobytes()])],
        names=["block", "part", "width", "counts"])


MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def align(docs: DataFrame, text: str = "text", paths: tuple[str, str] | None = None, stripe: int = STRIPE) -> DataFrame:
    """``docs`` without ``text``, plus ``MEASURES`` and ``groups`` (``a1,a2|b1;a3|b2`` in decimal ids).

    ``n_best`` counts the links whose pair count is the highest of their A id in all documents, ``count_sum`` adds
    the counts of all links. ``paths``: the byte-level vocabulary and the piece model; ``stripe``: pairs whose hash
    and counts are sent to the executors at once.
    """
    spark = docs.sparkSession
    text_batches(spark)
    paths = paths or vocabulary_paths()
    keep = [c for c in docs.columns if c != text and c not in (*MEASURES, "groups")]
    base = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(keep)], F.col(text).alias("_t"))
    with_id = encode_texts(base, "_t", paths).withColumn("_row", F.monotonically_increasing_id())
    names = [f"_c{i}" for i in range(len(keep))]
    ids, _ = staged(with_id.select("_row", *names, "_a", "_b"), "align-ids")
    enc = Encoders(*(open(p, "rb").read() for p in paths))
    tables, width = enc.tables, len(enc.tables[1].size)
    held = spark.sparkContext.broadcast(tables)

    def distinct_pairs(batches):
        for batch in batches:
            for _, g in _grouped(batch, held.value):
                yield pa.RecordBatch.from_arrays([pa.array(g.pairs(width).distinct)], names=["pair"])

    pairs, _ = staged(ids.select("_a", "_b").mapInArrow(distinct_pairs, "pair long").distinct(), "align-pairs")
    n_pairs = pairs.count()
    buckets = max(1, -(-n_pairs // BUCKET))
    table, _ = staged(hash_buckets(pairs, buckets), "align-hash")
    per = max(1, stripe // BUCKET)
    ranges = [(lo, min(lo + per, buckets)) for lo in range(0, buckets, per)]

    def load(lo, hi):
        own = table.where((F.col("bucket") >= lo) & (F.col("bucket") < hi)).toLocalIterator()
        return PairHash(sorted((r.bucket, list(r.sizes), bytes(r.bits), bytes(r.pairs)) for r in own), lo, hi, buckets)

    best, sums = np.zeros(len(tables[0].size), dtype=np.int64), []
    for lo, hi in ranges:   # one stripe at a time on the driver
        hashed = load(lo, hi)
        sums.append(pair_counts(ids, hashed, tables, width))
        counts = dense(sums[-1], len(hashed.pairs))
        np.maximum.at(best, hashed.pairs // width, counts)
    if len(ranges) == 1:
        out = look_up(ids, spark.sparkContext.broadcast((hashed, counts)), held, best, width, names, True)
    else:   # add up the stripes; what does not depend on counts comes from the first
        parts = []
        for i, (lo, hi) in enumerate(ranges):
            hashed = load(lo, hi)
            shared = spark.sparkContext.broadcast((hashed, dense(sums[i], len(hashed.pairs))))
            parts.append(stage(look_up(ids, shared, held, best, width, [], i == 0), "align-stripe"))
            shared.destroy()
        total = functools.reduce(DataFrame.unionByName, parts).groupBy("_row").agg(
            *[F.sum(m).alias(m) for m in MEASURES], F.max("groups").alias("groups"))
        out = ids.select("_row", *names).join(total, "_row")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], *MEASURES, "groups")


def look_up(ids: DataFrame, shared, held, best: np.ndarray, width: int, names: list[str], first: bool) -> DataFrame:
    """Rows of ``ids`` aligned again, with the measures under the counts of one stripe; measures that do not
    depend on counts are 0 unless ``first``."""
    src = ids.select("_row", *names, "_a", "_b")
    schema = T.StructType([*src.schema.fields[:-2], *[T.StructField(m, T.LongType()) for m in MEASURES],
                           T.StructField("groups", T.StringType())])

    def run(batches):
        hashed, counts = shared.value
        for batch in batches:
            for part, g in _grouped(batch, held.value):
                found = g.pairs(width)
                at = hashed.index(found.distinct)
                count = np.where(at >= 0, counts[at], 0) if len(counts) else at[:0]
                top = (at >= 0) & (count == best[found.distinct // width])
                sums = [np.zeros(g.docs, dtype=np.int64) for _ in range(2)]
                np.add.at(sums[0], found.doc, found.links * found.spread(top))
                np.add.at(sums[1], found.doc, found.links * found.spread(count))
                fixed = [np.diff(g.a_ptr), np.diff(g.b_ptr), g.per_doc(np.ones(g.n, dtype=np.int64)),
                         g.per_doc(g.na * g.nb)]
                fixed = fixed if first else [np.zeros(g.docs, dtype=np.int64)] * 4
                text = g.spelled() if first else pa.array([""] * g.docs)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in range(part.num_columns - 2)],
                                                  *[pa.array(x) for x in (*fixed, *sums)], text], names=schema.names)

    return src.mapInArrow(run, schema)


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return out.select("doc_id", *MEASURES, digest.alias("groups_sha256"))
