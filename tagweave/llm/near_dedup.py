"""Near-duplicate groups by an LSH forest over MinHash signatures.

1. A document is the set of its word shingles (64-bit hashes). Equal sets are one node, whatever their number.
2. Forest. ``TREES`` sorted orders of the nodes, each by ``DEPTH`` MinHash values of its own. Nodes whose
   signatures agree in the first ``LEAST`` values of a tree are a region; two sets of similarity 0.8 miss each
   other in all trees with probability (1 - 0.8**LEAST)**TREES, 3e-6. Regions denser than ``CAP`` nodes are cut
   deeper, by longer common prefixes, until they hold at most CAP (by a hash where the whole prefix is equal).
3. Candidates. Within a region, nodes whose whole signatures (TREES * DEPTH values) agree in at least
   ``AGREE`` of the places are candidates: six standard deviations below 0.8 similarity. What the deeper cut
   of a dense region has separated is compared block by block afterwards, unless already in one component.
4. Confirmation. The components of the candidate graph are families. The full sets of a family meet in one
   task, or in pairs of blocks of CAP sets for larger ones, and links are confirmed on them. Tasks return the
   components of what they have seen as one edge per node, never all pairs; pairs of blocks whose members are
   all connected already are skipped, since they cannot change a component.

No pair is dropped by size: every pair of a region is compared or known to be connected. Defined results:
null and empty texts have an empty set and are linked with nothing; documents with fewer words than the
shingle are the whole sequence; repeated rows are copies; documents with equal ids count as one; a null id
counts as larger than any other (such documents are told apart by their texts); an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.components import components
from tagweave.llm.shared import drop_stage, stage, staged, text_batches, text_of
from tagweave.llm.words import BASE, U, Words, mix, ngrams, slices, split_words, string_bytes

TREES, DEPTH, LEAST = 24, 8, 4
CAP = 256
VALUES = 2_000_000  # shingles in one block of a family
AGREE = 0.63
SIZE = TREES * DEPTH
_RNG = np.random.default_rng(20240607)
_MULT = _RNG.integers(1, 1 << 63, SIZE, dtype=np.uint64) * U(2) + U(1)


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all documents, offsets)."""
    docs = len(w.ptr) - 1
    counts = w.counts
    g = ngrams(w, k)
    doc = w.doc()
    left = np.repeat(w.ptr[1:], counts) - np.arange(len(w.hash))
    full = left >= k
    h, d = g[full], doc[full]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):  # the whole sequence, with its length: no shorter sequence equals it
        extra = np.array([_sequence(w.hash[w.ptr[s]:w.ptr[s + 1]]) for s in short], dtype=U)
        h, d = np.concatenate((h, extra)), np.concatenate((d, short))
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    return h, np.concatenate(([0], np.cumsum(np.bincount(d, minlength=docs))))


def _sequence(hashes: np.ndarray) -> int:
    out = len(hashes)
    for h in hashes.tolist():
        out = int(mix(np.array([(out * BASE ^ h) & (1 << 64) - 1], dtype=U))[0])
    return out


def signatures(h: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """(documents, SIZE) uint16 MinHash values; rows of empty sets are meaningless."""
    docs = len(ptr) - 1
    sig = np.zeros((docs, SIZE), dtype=np.uint16)
    has = np.flatnonzero(np.diff(ptr) > 0)
    if len(has):
        for i, a in enumerate(_MULT):
            low = np.minimum.reduceat(h * a, ptr[has])
            sig[has, i] = mix(low) >> U(48)
    return sig


def _words(column, lower):
    return split_words(*string_bytes(column), lower=lower)


def document_sets(docs: DataFrame, k: int, lower: bool = True) -> DataFrame:
    """(row key columns..., n, ka, kb, sig): size, 128-bit digest and signature of each document's set.

    ``docs`` is (d, text).
    """
    def run(batches):
        for batch in batches:
            for i, j in slices(batch.column(1)):
                part = batch.slice(i, j - i)
                h, ptr = shingle_sets(_words(part.column(1), lower), k)
                n = np.diff(ptr)
                digest = []
                for seed in (1, 2):  # order-free sums of two mixes
                    total = np.concatenate((np.zeros(1, dtype=U), np.cumsum(mix(h * U(2 * seed + 1) + U(seed)))))
                    digest.append(mix(total[ptr[1:]] - total[ptr[:-1]] + n.astype(U)).view(np.int64))
                sig = signatures(h, ptr)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n), pa.array(digest[0]), pa.array(digest[1]),
                     pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * SIZE), len(n), [None, pa.py_buffer(sig.tobytes())])
                       .cast(pa.binary())], names=["d", "n", "ka", "kb", "sig"])

    src = docs.select("d", text_of().alias("_text"))
    return src.mapInArrow(run, "d long, n long, ka long, kb long, sig binary")


def _prefix(tree: int, depth: int):
    """The first ``depth`` values of a tree, as bytes."""
    return F.substring("sig", 2 * tree * DEPTH + 1, 2 * depth)


def _groups(batches, keys: list[str]):
    """Record batches cut so that equal keys (sorted input) are never split; the keys as group numbers."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        cols = [t[k].to_numpy() for k in keys]
        new = np.zeros(t.num_rows, dtype=bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        last = int(np.flatnonzero(new)[-1])
        if last:
            yield t.slice(0, last).combine_chunks(), np.cumsum(new[:last]) - 1
        held = t.slice(last)
    if held is not None and held.num_rows:
        yield held.combine_chunks(), np.zeros(held.num_rows, dtype=np.int64)


def _roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest index connected to each of ``n`` by the pairs (x, y)."""
    lab = np.arange(n)
    while len(x):
        low = np.minimum(lab[x], lab[y])
        before = lab.copy()
        np.minimum.at(lab, x, low)
        np.minimum.at(lab, y, low)
        lab = lab[lab]
        if np.array_equal(before, lab):
            break
    return lab


def _edge_batch(node: np.ndarray, lab: np.ndarray):
    far = np.flatnonzero(lab != np.arange(len(lab)))
    a, b = node[far], node[lab[far]]
    keep = a != b
    return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])


def _agreeing(sig: np.ndarray, n: np.ndarray, group: np.ndarray, side: np.ndarray | None, least: int, percent: int):
    """Pairs of a group with at least ``least`` equal places and possible sizes (across sides, if given)."""
    xs, ys = [], []
    size = np.bincount(group).max() if len(group) else 0
    for k in range(1, size):
        i = np.flatnonzero(group[k:] == group[:-k])
        if not len(i):
            break
        j = i + k
        ok = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
        if side is not None:
            ok &= (side[i] == 2) | (side[i] != side[j])
        i, j = i[ok], j[ok]
        for s in range(0, len(i), 1 << 15):
            a, b = i[s:s + (1 << 15)], j[s:s + (1 << 15)]
            ok = (sig[a] == sig[b]).sum(1) >= least
            xs.append(a[ok])
            ys.append(b[ok])
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(xs), np.concatenate(ys)) if xs else (none, none)


def _candidate_task(percent: int):
    least = int(AGREE * SIZE * percent / 80)

    def run(batches):
        for t, group in _groups(batches, ["g1", "g2"]):
            sig = string_bytes(t["sig"])[0].view(np.uint16).reshape(-1, SIZE)
            node, n, side = t["node"].to_numpy(), t["n"].to_numpy(), t["side"].to_numpy()
            x, y = _agreeing(sig, n, group, side, least, percent)
            yield _edge_batch(node, _roots(len(node), x, y))
    return run


def _confirm_task(percent: int):
    def run(batches):
        for t, group in _groups(batches, ["g1", "g2"]):
            node, side = t["node"].to_numpy(), t["side"].to_numpy()
            sets = t["shingles"].combine_chunks()
            vals, off = sets.values.to_numpy(), sets.offsets.to_numpy()
            cut = np.flatnonzero(np.diff(np.concatenate(([-1], group, [group[-1] + 1]))))
            xs, ys = [], []
            for a, b in zip(cut[:-1], cut[1:]):
                if b - a > 1:
                    x, y = _links(vals[off[a]:off[b]], off[a:b + 1] - off[a], side[a:b], percent)
                    xs.append(x + a)
                    ys.append(y + a)
            none = np.zeros(0, dtype=np.int64)
            x, y = (np.concatenate(xs), np.concatenate(ys)) if xs else (none, none)
            yield _edge_batch(node, _roots(len(node), x, y))
    return run


def _links(vals: np.ndarray, off: np.ndarray, side: np.ndarray, percent: int):
    """Linked pairs of the sets, from exact intersection sizes."""
    m, n = len(off) - 1, np.diff(off)
    if m == 2:
        if 100 * n.min() < percent * n.max():
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        inter = np.array([[0, len(np.intersect1d(vals[:n[0]], vals[n[0]:], assume_unique=True))]])
        inter = np.vstack((inter, [[0, 0]]))
    else:
        member = np.repeat(np.arange(m), n)
        order = np.argsort(vals, kind="stable")
        v, who = vals[order], member[order]
        new = np.ones(len(v), dtype=bool)
        new[1:] = v[1:] != v[:-1]
        col = np.cumsum(new) - 1
        shared = np.bincount(col)[col] > 1
        _, col = np.unique(col[shared], return_inverse=True)
        who = who[shared]
        inter = np.zeros((m, m), dtype=np.int64)
        width = max(1, 4_000_000 // m)
        for lo in range(0, int(col[-1]) + 1 if len(col) else 0, width):
            a, b = np.searchsorted(col, [lo, lo + width])
            x = np.zeros((m, width), dtype=np.float32)
            x[who[a:b], col[a:b] - lo] = 1
            inter += (x @ x.T).astype(np.int64)
    union = n[:, None] + n[None, :] - inter
    ok = np.triu(100 * inter >= percent * union, 1)
    ok &= (side[:, None] == 2) | (side[:, None] != side[None, :])
    return np.nonzero(ok)


def link_groups(members: DataFrame, run, payload: str) -> DataFrame:
    """Edges (a, b) that connect, within every group g1, what ``run`` links.

    ``members`` is (g1, sub, node, n, payload): a group larger than CAP is first cut by ``sub`` (which must
    keep similar members together and hold about CAP of them), then block by block as far as its members are
    in different components.
    """
    cols = ["node", "n", payload]
    sized = members.groupBy("g1").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    m, path = staged(members.join(sized, "g1"), "near-members")
    spark = members.sparkSession
    small = m.where(F.col("size") <= CAP).select("g1", F.lit(0).cast("long").alias("g2"), F.lit(2).alias("side"), *cols)
    large = m.where(F.col("size") > CAP)
    first = small.unionByName(large.select("g1", F.col("sub").alias("g2"), F.lit(2).alias("side"), *cols))
    edges = stage(_run(first, run), "near-edges")
    if large.isEmpty():
        drop_stage(spark, path)
        return edges
    # what is left between the parts of large groups
    comp = components(edges)
    tagged = (large.join(comp, "node", "left")
                   .withColumn("component", F.coalesce("component", "node")))
    counts = tagged.groupBy("g1", "component").agg(F.count(F.lit(1)).alias("c"))
    main = counts.groupBy("g1").agg(F.max(F.struct("c", "component")).alias("x"), F.count(F.lit(1)).alias("parts"))
    main = main.where("parts > 1").select("g1", F.col("x.component").alias("main"), F.col("x.c").alias("main_size"))
    tagged = (tagged.join(main, "g1").withColumn("rest", F.col("component") != F.col("main"))
                    .withColumn("blocks", F.ceil(F.when(F.col("rest"), F.col("size") - F.col("main_size"))
                                                 .otherwise(F.col("main_size")) / CAP))
                    .withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), "blocks") + 1))
    # rest blocks are numbered 1.., blocks of the main component -1..; a task is (rest block, other block)
    rest = tagged.where("rest")
    n_rest = F.ceil((F.col("size") - F.col("main_size")) / CAP)
    n_main = F.ceil(F.col("main_size") / CAP)
    lone = rest.withColumn("o", F.explode(F.sequence(F.lit(1).cast("long"), n_rest)))
    lone = lone.select("g1", F.greatest("block", "o").alias("x"), F.least("block", "o").alias("y"),
                       F.when(F.col("o") == F.col("block"), 2).when(F.col("o") > F.col("block"), 0).otherwise(1).alias("side"), *cols)
    cross = rest.withColumn("o", F.explode(F.sequence(F.lit(1).cast("long"), n_main)))
    cross = cross.select("g1", F.col("block").alias("x"), (-F.col("o")).alias("y"), F.lit(0).alias("side"), *cols)
    body = tagged.where(~F.col("rest")).withColumn("o", F.explode(F.sequence(F.lit(1).cast("long"), n_rest)))
    body = body.select("g1", F.col("o").alias("x"), (-F.col("block")).alias("y"), F.lit(1).alias("side"), *cols)
    tasks = (lone.unionByName(cross).unionByName(body)
                 .select("g1", F.xxhash64("x", "y").alias("g2"), "side", *cols))
    more = stage(_run(tasks, run), "near-edges")
    drop_stage(spark, path)
    return edges.unionByName(more)


def _run(tasks: DataFrame, run) -> DataFrame:
    """Apply ``run`` to the rows of each (g1, g2), which are together and in order."""
    return (tasks.repartition("g1", "g2").sortWithinPartitions("g1", "g2", "node")
                 .mapInArrow(run, "a long, b long"))


def _region_members(nodes: DataFrame) -> DataFrame:
    """(g1, sub, node, n, sig): each node in each region with more than one node; sub is the adaptive cut."""
    levels = (LEAST, LEAST + 2, DEPTH)
    trees = F.array(*[F.struct(*[F.xxhash64(F.lit(t), _prefix(t, d)).alias(f"p{d}") for d in levels])
                      for t in range(TREES)])
    rows = nodes.select("node", F.explode(trees).alias("t")).select("node", "t.*")
    top = f"p{levels[0]}"
    many = rows.groupBy(top).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    rows, path = staged(rows.join(many, top), "near-regions")
    dense = rows.where(F.col("c") > CAP)
    for d in levels[1:]:
        count = dense.groupBy(f"p{d}").agg(F.count(F.lit(1)).alias(f"c{d}"))
        dense = dense.join(count, f"p{d}")
    a, b = levels[1:]
    salt = F.pmod(F.xxhash64("node"), F.ceil(F.col(f"c{b}") / CAP))
    sub = F.when(F.col(f"c{a}") <= CAP, F.col(f"p{a}")).otherwise(F.xxhash64(F.col(f"p{b}"), salt))
    dense = dense.select(F.col(top).alias("g1"), sub.alias("sub"), "node")
    sparse = rows.where(F.col("c") <= CAP).select(F.col(top).alias("g1"), F.lit(0).cast("long").alias("sub"), "node")
    return sparse.unionByName(dense).join(nodes.select("node", "n", "sig"), "node"), path


def near_duplicates(docs: DataFrame, shingle: int = 4, percent: int = 80, lower: bool = True) -> DataFrame:
    """(d, n_shingles, component) of every row of ``docs`` (d, text); d is the id, never null."""
    spark = docs.sparkSession
    text_batches(spark)
    sets, p_sets = staged(document_sets(docs, shingle, lower), "near-sets")
    nodes = stage(sets.where("n > 0").groupBy("ka", "kb", "n").agg(F.min("d").alias("node"), F.first("sig").alias("sig")),
                  "near-nodes")
    members, p_regions = _region_members(nodes)
    candidates = link_groups(members, _candidate_task(percent), "sig")
    families = stage(components(candidates), "near-families")
    # full sets of the families, read from the texts again
    sizes = families.groupBy("component").agg(F.count(F.lit(1)).alias("c"))
    full = _family_sets(docs, families, shingle, lower)
    weight = nodes.select("node", "n").join(families, "node").groupBy("component").agg(F.sum("n").alias("values"))
    full = full.join(weight.join(sizes, "component"), "component")
    parts = F.greatest(F.ceil(F.col("c") / CAP), F.ceil(F.col("values") / VALUES))
    big = full.select(F.col("component").alias("g1"), F.pmod(F.xxhash64("node", F.lit(1)), parts).alias("sub"),
                      "node", F.size("shingles").cast("long").alias("n"), "shingles")
    links = link_groups(big, _confirm_task(percent), "shingles")
    comp = components(links)
    named = (nodes.select("ka", "kb", "n", "node").join(comp, "node", "left")
                  .select("ka", "kb", "n", F.coalesce("component", "node").alias("component")))
    out = stage(sets.drop("sig").join(named, ["ka", "kb", "n"], "left")
                    .select("d", F.col("n").alias("n_shingles"), F.coalesce("component", "d").alias("component")),
                "near-result")
    for p in (p_sets, p_regions):
        drop_stage(spark, p)
    return out


def _family_sets(docs: DataFrame, families: DataFrame, k: int, lower: bool) -> DataFrame:
    """(component, node, shingles) of the families' nodes, from the texts."""
    src = (docs.join(families.withColumnRenamed("node", "d"), "d").select("component", "d", text_of().alias("_text"))
               .dropDuplicates(["d"]))

    def run(batches):
        for batch in batches:
            for i, j in slices(batch.column(2)):
                part = batch.slice(i, j - i)
                h, ptr = shingle_sets(_words(part.column(2), lower), k)
                sets = pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), sets],
                                                 names=["component", "node", "shingles"])

    return src.mapInArrow(run, "component long, node long, shingles array<long>")


#: Ids of documents without one start here; they are named by their text.
NO_ID = 1 << 62


def with_ids(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(d, text): ``d`` is never null, and larger than every given id where that is null."""
    unnamed = F.lit(NO_ID) + F.pmod(F.xxhash64(text_of(text)), F.lit(NO_ID >> 1))
    return docs.select(F.coalesce(F.col(key).cast("long"), unnamed).alias("d"), F.col(text).alias("text"))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate group (the smallest id), and repeated rows once."""
    names = docs.columns
    inner = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    k, t = (f"_c{names.index(c)}" for c in (key, text))
    groups = near_duplicates(with_ids(inner, k, t), shingle, percent)
    stay = stage(groups.where("d = component").select("d").distinct(), "near-kept")
    unnamed = F.lit(NO_ID) + F.pmod(F.xxhash64(text_of(t)), F.lit(NO_ID >> 1))
    keyed = inner.withColumns({"d": F.coalesce(F.col(k).cast("long"), unnamed), "th": F.xxhash64(text_of(t))})
    out = keyed.join(stay, "d", "left_semi").dropDuplicates(["d", "th"])
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = near_duplicates(with_ids(docs))
    named = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    return out.select(named("d").alias("doc_id"), "n_shingles", named("component").alias("component_id"),
                      (F.col("d") == F.col("component")).alias("kept"))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
e AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * shared >= 80 * (nx.n + ny.n - shared)),
reach AS (
  SELECT x, y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(c.y, w.doc_id)) AS component_id,
       coalesce(c.y, w.doc_id) >= w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id
LEFT JOIN (SELECT x, min(y) AS y FROM reach GROUP BY x) c ON c.x = w.doc_id"""
