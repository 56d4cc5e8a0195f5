"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Targets: sources in code-point order (null last) weigh 1, 2, 3, 1, ... and share the corpus by weight; a
   target stops at ``max_repeat`` times its source, the excess goes to the others by weight.
2. Blocks: the documents of a source, in hash order, form one axis of words, cut into blocks of
   ``block_words``. Each epoch permutes the blocks; a source's quota is a number of positions in that draw
   order, the last block trimmed so that the words drawn are the target exactly.
3. Tree: the node of all output shards holds the quotas of all sources. It is halved again and again; the
   left half draws its blocks without replacement, so the number from each source is multivariate
   hypergeometric. Nodes are groups of one row per source, split in parallel.
4. Shards take disjoint ranges of each source's permuted positions and order their pieces by a hash.

Only numbers are shuffled, never texts. A source with a third of all rows is cut into buckets of about
``bucket_docs`` documents for the running sums.

Defined results: size 0 (null or empty text) is taken 0 times; null source is a source, last in order; every
row is a document of its own, so repeated rows are mixed as such; an empty table gives an empty result; equal
input and parameters give equal results; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagweave.llm.shared import SPACE, SPACE_RE, stage, text_of

#: Primes below 2**31: multipliers of the block permutations, coprime to every number of blocks.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549)
MAX_BLOCKS = 500_000_000  # blocks grow with the corpus beyond this many
LEVELS = 6                # of the tree that one task splits


def word_count(text):
    t = F.btrim(text, F.lit(SPACE))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, SPACE_RE))).cast("long")


def source_targets(sizes: DataFrame, weights=(1, 2, 3), share: float = 1.0, max_repeat: int = 3) -> DataFrame:
    """(source, n_docs, source_size, rank, target) from (source, n_docs, source_size).

    Sources are filled in the order of cap / weight: the level at the first source that stays below its cap
    is the final one, and it is the largest of all levels met.
    """
    every = Window.partitionBy(F.lit(0))
    order = every.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("rank"), F.lit(len(weights))) + 1)
    s = (sizes.withColumn("rank", F.row_number().over(order) - 1)
              .withColumn("w", w).withColumn("cap", F.col("source_size") * float(max_repeat)))
    filled = every.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    used = lambda c: F.coalesce(F.sum(c).over(filled), F.lit(0.0))
    total = F.sum("source_size").over(every) * share
    s = (s.withColumn("level", (total - used("cap")) / (F.sum("w").over(every) - used("w")))
          .withColumn("level", F.max("level").over(every)))
    return s.withColumn("target", F.least("cap", F.col("w") * F.col("level"))).drop("w", "cap", "level")


def _split_node(seed: int):
    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        """Split one node (lo, hi, rank, n) into nodes LEVELS deeper, or shards."""
        pdf = pdf.sort_values("rank")
        ranks, out = pdf["rank"].to_numpy(), []
        todo = [(int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0]), pdf["n"].to_numpy(), 0)]
        while todo:
            lo, hi, n, depth = todo.pop()
            if hi - lo == 1 or depth == LEVELS:
                out.append(pd.DataFrame({"lo": lo, "hi": hi, "rank": ranks, "n": n}))
                continue
            mid, rng = (lo + hi) // 2, np.random.default_rng([seed, lo, hi])
            total = int(n.sum())
            want, rest, left = total * (mid - lo) // (hi - lo), total, np.zeros_like(n)
            for i, have in enumerate(n.tolist()):
                rest -= have
                left[i] = rng.hypergeometric(have, rest, want) if want else 0
                want -= int(left[i])
            todo += [(lo, mid, left, depth + 1), (mid, hi, n - left, depth + 1)]
        return pd.concat(out)
    return split


def shard_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(rank, shard, first, n): the range of each source's draw positions that each shard takes."""
    node = quotas.select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "rank",
                         F.col("quota").alias("n"))
    width = shards
    while width > 1:
        node = node.groupBy("lo", "hi").applyInPandas(_split_node(seed), "lo long, hi long, rank int, n long")
        width = -(-width // (1 << LEVELS))
    before = Window.partitionBy("rank").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    return node.select("rank", F.col("lo").alias("shard"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"),
                       "n")


def _permuted(block, blocks, rank, epoch, seed):
    """A permutation of 0 .. blocks - 1, another one for each source and epoch."""
    pick = F.xxhash64(F.lit(seed), rank, epoch)
    a = F.element_at(F.array(*[F.lit(p) for p in PRIMES]), F.pmod(pick, F.lit(len(PRIMES))).cast("int") + 1)
    return F.pmod(a * block + F.pmod(F.shiftrightunsigned(pick, 33), blocks), blocks)


def plan(docs: DataFrame, weights=(1, 2, 3), share: float = 1.0, max_repeat: int = 3, block_words: int = 2048,
         blocks_per_shard: int = 1024, bucket_docs: int = 1000, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Returns (documents, pieces).

    documents: row, doc_id, source, size, source_size, target. pieces, the mix itself: shard, slot (order
    within the shard), row, doc_id, epoch, first_word, n_words of the document.
    """
    spark = docs.sparkSession
    sized = docs.select("doc_id", "source", word_count(text_of()).alias("size"),
                        F.xxhash64(F.lit(seed), F.col("doc_id"), text_of()).alias("h"),
                        F.monotonically_increasing_id().alias("row"))
    sized = stage(sized, "mix-sizes")
    sizes = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    t = stage(source_targets(sizes, weights, share, max_repeat), "mix-targets")

    # blocks and quotas, one row per source
    total = t.agg(F.sum("target")).first()[0] or 0.0
    block = max(block_words, int(total // MAX_BLOCKS))
    size, tgt = F.col("source_size"), F.round("target").cast("long")
    q = (t.withColumn("blocks", F.ceil(size / block).cast("long"))
          .withColumn("epochs", F.when(size > 0, F.floor(tgt / size)).otherwise(0).cast("int"))
          .withColumn("rest", F.when(size > 0, tgt - F.col("epochs") * size).otherwise(0)))
    # in the last, partial epoch the source's short block stands at this position
    short_at = _permuted(F.col("blocks") - 1, F.col("blocks"), F.col("rank"), F.col("epochs"), seed)
    lack = F.col("blocks") * block - size
    rest = F.col("rest") + F.when(F.col("rest") > short_at * block, lack).otherwise(0)
    q = (q.withColumn("_rest", F.when(size > 0, rest).otherwise(0))
          .withColumn("partial", F.ceil(F.col("_rest") / block).cast("long"))
          .withColumn("trim", F.when(F.col("partial") > 0, F.col("_rest") - (F.col("partial") - 1) * block).otherwise(block))
          .withColumn("quota", F.col("epochs") * F.col("blocks") + F.col("partial")).drop("_rest"))
    q = stage(q, "mix-quotas")
    n_blocks = q.agg(F.sum("quota")).first()[0] or 0
    shards = max(1, -(-n_blocks // blocks_per_shard))
    owners = (shard_quotas(q, shards, seed).where("n > 0")
              .select("rank", "shard", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("pos")))

    # running sum of words within each source: over buckets of the hash order, then within a bucket
    d = sized.join(t.select(F.col("source").alias("_s"), "rank", "n_docs", "source_size", "target"),
                   F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    key = F.shiftrightunsigned("h", 2)
    d = d.withColumn("bucket", F.floor(key / F.lit(float(1 << 62)) * F.ceil(F.col("n_docs") / bucket_docs)).cast("long"))
    sums = d.groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("rank", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inner = (Window.partitionBy("rank", "bucket").orderBy(key, "h", "doc_id", "size", "row")
                   .rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("at", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    d = d.join(sums, ["rank", "bucket"]).withColumn("at", F.col("at") + F.col("base"))

    b = F.lit(block).cast("long")
    p = (d.where("size > 0")
          .join(q.select("rank", "blocks", "epochs", "partial", "trim", "quota"), "rank").where("quota > 0")
          .withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / b), F.floor((F.col("at") + F.col("size") - 1) / b))))
          .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - F.when(F.col("partial") > 0, 0).otherwise(1)))))
    p = (p.withColumn("pos", F.col("epoch") * F.col("blocks")
                      + _permuted(F.col("block"), F.col("blocks"), F.col("rank"), F.col("epoch"), seed))
          .where(F.col("pos") < F.col("quota")))
    limit = F.col("block") * b + F.when((F.col("pos") == F.col("quota") - 1) & (F.col("partial") > 0), F.col("trim")).otherwise(b)
    p = (p.withColumn("first_word", F.greatest(F.lit(0), F.col("block") * b - F.col("at")))
          .withColumn("n_words", F.least(F.col("at") + F.col("size"), limit) - F.col("at") - F.col("first_word"))
          .where("n_words > 0"))
    pieces = (p.join(owners, ["rank", "pos"])
               .select("shard", F.xxhash64(F.lit(seed), "shard", "rank", "pos").alias("slot"), "row", "doc_id",
                       "epoch", "first_word", "n_words"))
    return d.select("row", "doc_id", "source", "size", "source_size", "target"), pieces


def mix(docs: DataFrame, **params) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted), n_pieces, n_shards (those
    that hold a piece of it), dealt (hexadecimal digest of the pieces with their shards and places there; '' without any).

    The quotas alone say how much a source gives; which shard gets it, where, is what the tree deals out.
    """
    rows, pieces = plan(docs, **params)
    place = F.xxhash64("shard", "slot", "epoch", "first_word", "n_words")
    per_shard = pieces.groupBy("row", "shard").agg(F.sum("n_words").alias("taken"), F.count(F.lit(1)).alias("n_pieces"),
                                                   F.bit_xor(place).alias("dealt"))
    taken = per_shard.groupBy("row").agg(F.sum("taken").alias("taken"), F.sum("n_pieces").alias("n_pieces"),
                                         F.count(F.lit(1)).alias("n_shards"), F.bit_xor("dealt").alias("dealt"))
    none = F.lit(0).cast("long")
    return (rows.join(taken, "row", "left")
                .select("doc_id", "size", "source_size", "target",
                        *[F.coalesce(c, none).alias(c) for c in ("taken", "n_pieces", "n_shards")],
                        F.coalesce(F.lower(F.hex("dealt")), F.lit("")).alias("dealt")))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
