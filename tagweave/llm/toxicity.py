"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in NumPy.

Inputs per word: an embedding of the word (for words known from training) and the mean embedding of its
character trigrams (hashed bytes with word ends). Two GRUs read the window in both directions, attention
pools their states, a linear layer gives the logit. Every text is scored whole: windows of ``WINDOW`` words,
one every ``STRIDE``, so each run of WINDOW - STRIDE words lies whole within a window. The document's logit is
the largest of its windows', and two calibration parameters turn it into a score. Logits are rounded to ``GRAIN``,
since the last bits of 32-bit sums depend on how many windows are multiplied at once: so equal texts get equal scores
(unless a sum falls within those bits of a rounding edge).

Training sees at most ``max_train`` labelled documents of each kind (smallest hashes of the id), a documented
bound; of each one the window whose words are most telling and ``EXTRA`` others. Words are known if found in
enough of these documents, unevenly enough (at most ``VOCABULARY``); their embeddings start from that. Calibration
learns from at most ``max_calibrate`` labelled documents, chosen alike. Everything is seeded: equal tables give equal
scores.

Defined results: null and empty texts have no words and get the score of a window without evidence; a label
row counts as often as it is repeated; null labels are ignored; with labels of one kind or none every score
is the share of positive labels (0 without labels); an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.shared import stage, text_batches, text_of
from tagweave.llm.words import PUNCT_BYTES, U, Words, slices, split_words, string_bytes

WINDOW, STRIDE, EXTRA = 64, 32, 2
VOCABULARY = 20_000
CHARS = 4096  # trigram buckets
EMB, HID = 8, 8
UPDATES, BATCH, RATE, DECAY = 320, 192, 0.02, 0.02
GRAIN = 1 / 1024
TELLING = 4.0  # least root of a known word's likelihood ratio


def _words(column: pa.Array) -> Words:
    return split_words(*string_bytes(column), separators=PUNCT_BYTES, lower=True)


def windows(counts: np.ndarray):
    """(document, first word) of the windows of documents with ``counts`` words; one for an empty document."""
    n = np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(counts)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return doc, k * STRIDE


def trigrams(w: Words, pick: np.ndarray):
    """(bucket, word) of the character trigrams of the words ``pick``."""
    size = (w.end - w.start)[pick]
    word = np.repeat(np.arange(len(pick)), size)
    step = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    at = np.repeat(w.start[pick], size) + step
    pad = np.concatenate(([94], w.data, [36])).astype(np.int64)
    left = np.where(step == 0, 94, pad[at])
    right = np.where(step == np.repeat(size, size) - 1, 36, pad[np.minimum(at + 2, len(pad) - 1)])
    code = (left << 16 | pad[at + 1] << 8 | right).astype(U) * U(0x9E3779B97F4A7C15)
    return (code >> U(52)).astype(np.int64), word, np.maximum(size, 1)


def lookup(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Row of each hash in the sorted vocabulary, plus one; 0 is unknown."""
    if not len(vocabulary):
        return np.zeros(len(hashes), dtype=np.int64)
    i = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[i] == hashes, i + 1, 0)


def _sig(x):
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def init(vocabulary: np.ndarray, odds: np.ndarray, seed: int = 7) -> dict:
    rng = np.random.default_rng(seed)
    f = lambda *s, scale=0.1: rng.normal(0, scale, s).astype(np.float32)
    p = {"word": f(len(vocabulary) + 1, EMB, scale=0.02), "char": f(CHARS, EMB, scale=0.1),
         "v": f(2 * HID, scale=0.5), "out": f(2 * HID, scale=0.5), "b": np.zeros(1, dtype=np.float32)}
    p["word"][0] = 0
    p["word"][1:, 0] += np.clip(odds / 4, -2, 2).astype(np.float32)
    for d in ("f", "g"):
        p[f"w{d}"] = f(2 * EMB, 3 * HID, scale=0.4)
        p[f"u{d}"] = f(HID, 3 * HID, scale=0.3)
        p[f"c{d}"] = np.zeros(3 * HID, dtype=np.float32)
    return p


def embed(p: dict, word: np.ndarray, bucket: np.ndarray, owner: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(words, 2 * EMB) inputs; word rows, and trigram buckets with the word each belongs to (in order)."""
    chars = np.zeros((len(word), EMB), dtype=np.float32)
    if len(bucket):
        first = np.searchsorted(owner, np.arange(len(word)))
        chars = np.add.reduceat(p["char"][bucket], np.minimum(first, len(bucket) - 1), axis=0) / size[:, None].astype(np.float32)
    return np.concatenate((p["word"][word], chars), axis=1)


def _gru(x: np.ndarray, u: np.ndarray, keep: bool):
    """States (T, B, HID) of a GRU over projected inputs (T, B, 3 HID); with ``keep`` also what BPTT needs."""
    steps, b, _ = x.shape
    h = np.zeros((b, HID), dtype=np.float32)
    out = np.empty((steps, b, HID), dtype=np.float32)
    saved = []
    for t in range(steps):
        a = h @ u
        zr = _sig(x[t, :, :2 * HID] + a[:, :2 * HID])
        z, r = zr[:, :HID], zr[:, HID:]
        n = np.tanh(x[t, :, 2 * HID:] + r * a[:, 2 * HID:])
        if keep:
            saved.append((h, z, r, n, a[:, 2 * HID:]))
        h = n + z * (h - n)
        out[t] = h
    return out, saved


def _gru_back(dh_all: np.ndarray, saved, u: np.ndarray):
    """Gradients of the projected inputs and of ``u``."""
    steps, b, _ = dh_all.shape
    dx = np.empty((steps, b, 3 * HID), dtype=np.float32)
    du = np.zeros_like(u)
    carry = np.zeros((b, HID), dtype=np.float32)
    for t in range(steps - 1, -1, -1):
        h, z, r, n, a = saved[t]
        d = dh_all[t] + carry
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (h - n) * z * (1 - z)
        dr = dn * a * r * (1 - r)
        dx[t] = np.concatenate((dz, dr, dn), axis=1)
        da = np.concatenate((dz, dr, dn * r), axis=1)
        du += h.T @ da
        carry = d * z + da @ u.T
    return dx, du


def _attend(p: dict, h: np.ndarray, mask: np.ndarray):
    """(logits, attention, pooled) of states (T, B, 2 HID)."""
    s = np.where(mask, h @ p["v"], np.float32(-1e4))
    e = np.exp(s - s.max(0))
    a = e / e.sum(0)
    pooled = np.einsum("tb,tbh->bh", a, h)
    return pooled @ p["out"] + p["b"][0], a, pooled


def forward(p: dict, proj: dict, index: np.ndarray) -> np.ndarray:
    """Logits of windows. ``index`` (T, B) are rows of the projected inputs, 0 the padding."""
    f, _ = _gru(proj["f"][index], p["uf"], False)
    g, _ = _gru(proj["g"][index[::-1]], p["ug"], False)
    return _attend(p, np.concatenate((f, g[::-1]), axis=2), _mask(index))[0]


def _mask(index):
    m = index > 0
    m[0] |= ~m.any(0)  # an empty window attends to its padding
    return m


def project(p: dict, x: np.ndarray) -> dict:
    """Inputs of both directions; row 0 is the padding."""
    x = np.concatenate((np.zeros((1, x.shape[1]), dtype=np.float32), x))
    return {d: x @ p[f"w{d}"] + p[f"c{d}"] for d in ("f", "g")}


def train(p: dict, index: np.ndarray, y: np.ndarray, word, bucket, owner, size, updates=UPDATES, seed: int = 7) -> dict:
    """Adam on the logistic loss. ``index`` (windows, T) are rows of the distinct words plus one."""
    updates = int(min(updates, max(80, 25 * len(y) / BATCH)))  # about 25 epochs at most
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    first = np.searchsorted(owner, np.arange(len(word)))
    stop = np.append(first[1:], len(bucket))
    pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    for step in range(1, updates + 1):
        pick = np.concatenate((rng.choice(pos, BATCH // 3), rng.choice(neg, BATCH - BATCH // 3)))
        idx = np.ascontiguousarray(index[pick].T)
        used, inv = np.unique(idx, return_inverse=True)
        inv = inv.reshape(idx.shape)
        w = used[used > 0] - 1
        shift = int(used[0] != 0)  # rows of the batch: 0 is the padding
        inv = inv + shift
        cnt = stop[w] - first[w]
        own = np.repeat(np.arange(len(w)), cnt)
        bk = bucket[np.repeat(first[w] - (np.cumsum(cnt) - cnt), cnt) + np.arange(cnt.sum())]
        x = embed(p, word[w], bk, own, size[w])
        proj = project(p, x)
        xf, xg = proj["f"][inv], proj["g"][inv[::-1]]
        f, sf = _gru(xf, p["uf"], True)
        g, sg = _gru(xg, p["ug"], True)
        h = np.concatenate((f, g[::-1]), axis=2)
        logit, a, pooled = _attend(p, h, _mask(inv > 0))
        d = ((1 / (1 + np.exp(-logit)) - y[pick]) / len(pick)).astype(np.float32)
        grad = {"out": pooled.T @ d, "b": d.sum(keepdims=True)}
        dp = d[:, None] * p["out"]
        da = np.einsum("tbh,bh->tb", h, dp)
        ds = a * (da - (a * da).sum(0))
        dh = a[:, :, None] * dp[None] + ds[:, :, None] * p["v"]
        grad["v"] = np.einsum("tb,tbh->h", ds, h)
        dxf, grad["uf"] = _gru_back(dh[:, :, :HID], sf, p["uf"])
        dxg, grad["ug"] = _gru_back(np.ascontiguousarray(dh[::-1, :, HID:]), sg, p["ug"])
        x0 = np.concatenate((np.zeros((1, 2 * EMB), dtype=np.float32), x))
        rows = inv.ravel()
        sums = []
        for name, dx in (("f", dxf), ("g", dxg[::-1])):
            flat = dx.reshape(-1, 3 * HID)
            total = np.stack([np.bincount(rows, weights=flat[:, c], minlength=len(x0)) for c in range(3 * HID)], axis=1)
            total = total.astype(np.float32)
            grad[f"w{name}"], grad[f"c{name}"] = x0.T @ total, total.sum(0)
            sums.append(total @ p[f"w{name}"].T)
        dxw = (sums[0] + sums[1])[1:]
        grad["word"] = np.zeros_like(p["word"])
        np.add.at(grad["word"], word[w], dxw[:, :EMB])
        grad["word"][0] = 0
        grad["char"] = np.zeros_like(p["char"])
        np.add.at(grad["char"], bk, np.repeat(dxw[:, EMB:] / size[w][:, None], cnt, axis=0).astype(np.float32))
        norm = np.sqrt(sum(float((v * v).sum()) for v in grad.values()))
        clip = min(1.0, 5.0 / (norm + 1e-9))
        rate = RATE * min(1, step / 20) * (1 - 0.8 * step / updates)
        for k, v in grad.items():
            v = v * np.float32(clip)
            m[k] = 0.9 * m[k] + 0.1 * v
            s[k] = 0.99 * s[k] + 0.01 * v * v
            if k in ("word", "char"):
                p[k] = p[k] * np.float32(1 - rate * DECAY)
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
    return p


def text_inputs(w: Words, vocabulary: np.ndarray):
    """Distinct words of a slice as network inputs: (row of each word + 1, word, bucket, owner, size)."""
    _, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    bucket, owner, size = trigrams(w, first)
    return inverse + 1, lookup(vocabulary, w.hash[first]), bucket, owner, size


def window_index(w: Words, rows: np.ndarray, doc: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(T, windows) input rows; positions after the document's end are 0."""
    at = w.ptr[doc] + first
    pos = at[None, :] + np.arange(WINDOW)[:, None]
    inside = pos < w.ptr[doc + 1][None, :]
    return np.where(inside, np.append(rows, 0)[np.minimum(pos, len(rows))], 0)


def score_column(column: pa.Array, vocabulary: np.ndarray, p: dict) -> np.ndarray:
    """Largest window logit of each text."""
    w = _words(column)
    rows, word, bucket, owner, size = text_inputs(w, vocabulary)
    proj = project(p, embed(p, word, bucket, owner, size))
    doc, first = windows(w.counts)
    out = np.full(len(w.ptr) - 1, -np.inf)
    for lo in range(0, len(doc), 4096):
        d, f = doc[lo:lo + 4096], first[lo:lo + 4096]
        np.maximum.at(out, d, forward(p, proj, window_index(w, rows, d, f)))
    return np.round(out / GRAIN) * GRAIN


def _distinct_words(train_docs: DataFrame) -> DataFrame:
    """(h, y): each distinct word of each training document."""
    def run(batches):
        for batch in batches:
            for i, j in slices(batch.column(1)):
                w = _words(batch.column(1).slice(i, j - i))
                doc = w.doc()
                order = np.lexsort((w.hash, doc))
                h, d = w.hash[order], doc[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[new].view(np.int64)), batch.column(0).slice(i, j - i).take(pa.array(d[new]))], names=["h", "y"])

    return train_docs.select("y", "text").mapInArrow(run, "h long, y int")


def _train_windows(train_docs: DataFrame, vocabulary: np.ndarray, odds: np.ndarray) -> DataFrame:
    """(y, rank, text): the most telling window of each document (rank 0) and EXTRA spread over it."""
    def run(batches):
        for batch in batches:
            for i, j in slices(batch.column(1)):
                part = batch.slice(i, j - i)
                w = _words(part.column(1))
                value = np.append(0, odds)[lookup(vocabulary, w.hash)]
                doc, first = windows(w.counts)
                total = np.concatenate(([0], np.cumsum(np.maximum(value, 0) ** 2)))
                lo = w.ptr[doc] + first
                hi = np.minimum(lo + WINDOW, w.ptr[doc + 1])
                gain = total[hi] - total[lo]
                order = np.lexsort((first, -gain, doc))
                rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
                share = np.bincount(doc)[doc]
                spread = (rank > 0) & (rank * (EXTRA + 1) // share > (rank - 1) * (EXTRA + 1) // share)
                keep = order[(rank == 0) | spread]
                d, lo, hi, rk = doc[order], lo[order], hi[order], rank
                use = (rank == 0) | spread
                lo, hi, d, rk = lo[use], hi[use], d[use], rk[use]
                text = []
                for a, b in zip(lo.tolist(), hi.tolist()):
                    text.append(w.data[w.start[a]:w.end[b - 1]].tobytes().decode("utf-8", "replace") if b > a else "")
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(d)), pa.array(np.minimum(rk, 1).astype(np.int32)), pa.array(text)],
                    names=["y", "rank", "text"])

    return train_docs.select("y", "text").mapInArrow(run, "y int, rank int, text string")


def fit(docs: DataFrame, labels: DataFrame, label: str, max_train: int, min_docs: int = 3) -> tuple[np.ndarray, dict] | None:
    """(vocabulary, parameters), or None without labels of both kinds."""
    rows = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y"))
    ids = [rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train) for y in (0, 1)]
    ids = stage(ids[0].unionByName(ids[1]), "toxic-ids")  # at most 2 * max_train rows
    found = stage(docs.select("doc_id", text_of().alias("text")).join(F.broadcast(ids), "doc_id").select("y", "text"),
                  "toxic-train")
    kinds = {r["y"]: r["n"] for r in found.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(kinds) < 2:
        return None
    n1, n0 = kinds[1], kinds[0]
    df = (_distinct_words(found).groupBy("h").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
                                .where(F.col("a") + F.col("b") >= min_docs))
    # signed root of the likelihood ratio of the word's counts: what chance explains is left out
    n, share = F.col("a") + F.col("b"), n1 / (n1 + n0)
    part = lambda c, q: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (n * q))).otherwise(0.0)
    root = F.sqrt(F.greatest(F.lit(0.0), 2 * (part("a", share) + part("b", 1 - share))))
    df = df.withColumn("odds", F.when(F.col("a") >= n * share, root).otherwise(-root)).where(F.abs("odds") >= TELLING)
    top = df.orderBy(F.abs("odds").desc(), "h").limit(VOCABULARY).select("h", "odds").toPandas()
    vocabulary = top["h"].to_numpy(dtype=np.int64).view(U)
    order = np.argsort(vocabulary)
    vocabulary, odds = vocabulary[order], top["odds"].to_numpy(dtype=float)[order]
    win = _train_windows(found, vocabulary, odds).orderBy("y", "rank", "text").toPandas()
    # other windows of a toxic document may be clean: only its most telling one is an example
    win = win[(win["y"] == 0) | (win["rank"] == 0)]
    w = _words(pa.array(win["text"].tolist(), type=pa.string()))
    word_rows, word, bucket, owner, size = text_inputs(w, vocabulary)
    idx = window_index(w, word_rows, np.arange(len(win)), np.zeros(len(win), dtype=np.int64)).T
    p = train(init(vocabulary, odds), np.ascontiguousarray(idx), win["y"].to_numpy(), word, bucket, owner, size)
    return vocabulary, p


def calibrate(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of labels over document logits (Newton steps)."""
    x = np.stack([np.clip(logit, -15, 15), np.ones(len(logit))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (q - y) / len(y) + 1e-4 * w
        hess = (x * (q * (1 - q))[:, None]).T @ x / len(y) + 1e-4 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_train: int = 2500,
                    max_calibrate: int = 10_000) -> DataFrame:
    """(doc_id, score) of every document; ``labels`` (doc_id, label) holds the rows to learn from."""
    spark = docs.sparkSession
    text_batches(spark)
    model = fit(docs, labels, label, max_train)
    if model is None:
        share = labels.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
        return docs.select("doc_id", F.lit(float(share)).alias("score"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        vocabulary, p = shared.value
        for batch in batches:
            for i, j in slices(batch.column(1), 1 << 20):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(score_column(batch.column(1).slice(i, j - i), vocabulary, p))],
                    names=["doc_id", "logit"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("_text"))
    logits = stage(src.mapInArrow(run, "doc_id long, logit double"), "toxic-logits")
    known = (labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y"))
                   .join(logits, "doc_id").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(max_calibrate)
                   .select("logit", "y").toPandas())
    a, b = calibrate(known["logit"].to_numpy(), known["y"].to_numpy())
    x = F.greatest(F.lit(-15.0), F.least(F.lit(15.0), F.col("logit")))
    return logits.select("doc_id", (1 / (1 + F.exp(-(x * a + b)))).alias("score"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    fold = lambda c: F.pmod(F.crc32(F.col(c).cast("string")), F.lit(5))
    out = score_documents(docs, labels.where(fold("doc_id") != 0))
    return out.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))
