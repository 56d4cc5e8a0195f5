"""Quality classifier learned from preference pairs (Bradley-Terry).

A document has features of its form (shares of symbols, capitals, repeated words and lines, word lengths).
A pair is a document labelled good and one labelled bad; the model gives each document a score, a linear
function of its features, and the probability that the good one wins is the logistic function of the score
difference. The weights minimise the logistic loss over pairs (Newton steps, L2). The threshold is the score
quantile that separates the training labels best; scores are shifted so that it lands on 0.7.

Features are computed in one pass over all texts and staged; the fit sees at most ``max_train`` labelled rows
(those with the smallest hash of the id) and draws at most ``max_pairs`` pairs of them, documented bounds. Scoring is
a column expression.

Defined results: null and empty texts have all-zero features and get a score like any other; a label row
counts as often as it is repeated; null labels are ignored; without labels of both kinds all weights are 0
and every score is the share of good labels (0.5 without labels); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.llm.shared import stage, text_of
from tagweave.llm.words import BASE, U, mix, slices, split_words, string_bytes

FEATURES = ("log_words", "mean_word", "long_words", "symbols", "bangs", "pipes", "digits", "capitals", "commas",
            "equal_next", "repeated_words", "top_word", "repeated_lines", "line_words", "symbol_words", "caps_words")
THRESHOLD = 0.7


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[[ord(c) for c in chars]] = True
    return t


_SYMBOLS, _BANGS, _PIPES, _COMMAS = _table("#*$%&<>{}[]\\^~=_@"), _table("!?"), _table("|"), _table(",.;:")
_DIGITS, _CAPS = _table("0123456789"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTERS = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


def features(column: pa.Array) -> np.ndarray:
    """(documents, len(FEATURES)) array."""
    data, off = string_bytes(column)
    docs = len(off) - 1
    w = split_words(data, off)
    doc, n = w.doc(), np.maximum(w.counts, 1).astype(float)
    size = np.maximum(np.diff(off), 1).astype(float)

    def chars(table):
        c = np.concatenate(([0], np.cumsum(table[data])))
        return c, (c[off[1:]] - c[off[:-1]]).astype(float)

    per = lambda v: np.bincount(doc, weights=v, minlength=docs)
    lens = w.end - w.start
    sym_c, sym = chars(_SYMBOLS)
    caps_c, caps = chars(_CAPS)
    let_c, letters = chars(_LETTERS)
    lead = np.cumsum(data == 10)
    next_equal = np.zeros(len(w.hash))
    next_equal[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((w.hash, doc))
    h, d = w.hash[order], doc[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    group = np.cumsum(new) - 1
    top = np.zeros(docs)
    if len(order):
        np.maximum.at(top, d[new], np.bincount(group))
    # lines equal to an earlier one of the document, by a hash of all their words in order
    line = lead[w.start] if len(w.start) else np.zeros(0, dtype=np.int64)
    opens = np.ones(len(line), dtype=bool)
    opens[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    n_lines = np.maximum(per(opens), 1)
    o = np.flatnonzero(opens)
    place = np.arange(len(line)) - np.repeat(o, np.diff(np.append(o, len(line))))
    whole = np.add.reduceat(mix(w.hash + place.astype(U) * U(BASE)), o) if len(o) else np.zeros(0, dtype=U)
    by = np.lexsort((whole, doc[o]))
    again = np.zeros(len(o), dtype=bool)
    again[1:] = (whole[by][1:] == whole[by][:-1]) & (doc[o][by][1:] == doc[o][by][:-1])
    lo = o[by]
    rep_lines = np.bincount(doc[lo[again]], minlength=docs)
    wl = np.maximum(let_c[w.end] - let_c[w.start], 1)
    cols = [np.log1p(w.counts), per(lens) / n / 10, per(lens > 20) / n, sym / size, chars(_BANGS)[1] / size,
            chars(_PIPES)[1] / size, chars(_DIGITS)[1] / size, caps / np.maximum(letters, 1), chars(_COMMAS)[1] / size,
            per(next_equal) / n, 1 - per_unique(new, d, docs) / n * (w.counts > 0) - (w.counts == 0), top / n,
            rep_lines / n_lines, np.log1p(n / n_lines), per(sym_c[w.end] > sym_c[w.start]) / n,
            per((caps_c[w.end] - caps_c[w.start] > 0.5 * wl) & (lens > 1)) / n]
    out = np.stack(cols, axis=1)
    out[w.counts == 0] = 0
    return out


def per_unique(new, d, docs):
    return np.bincount(d[new], minlength=docs)


def document_features(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    src = docs.select(key, text_of(text).alias("_text"))
    schema = T.StructType([src.schema[0], T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            for i, j in slices(batch.column(1)):
                x = features(batch.column(1).slice(i, j - i))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), type=pa.int32()),
                                                pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), flat], names=[key, "x"])

    return src.mapInArrow(run, schema)


def fit(x: np.ndarray, y: np.ndarray, max_pairs: int = 60_000, l2: float = 1e-3, seed: int = 7) -> dict:
    """Weights, offset and threshold from labelled feature rows."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    k = x.shape[1] if x.ndim == 2 and len(x) else len(FEATURES)
    if not len(good) or not len(bad):
        share = float(y.mean()) if len(y) else 0.5
        p = min(max(share, 1e-3), 1 - 1e-3)
        return {"w": np.zeros(k), "cut": -float(np.log(p / (1 - p))) + float(np.log(THRESHOLD / (1 - THRESHOLD)))}
    mean, std = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - mean) / std, -8, 8)
    rng = np.random.default_rng(seed)
    m = min(max_pairs, 20 * max(len(good), len(bad)))
    d = z[rng.choice(good, m)] - z[rng.choice(bad, m)]
    w = np.zeros(k)
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # probability that the bad one wins
        grad = -d.T @ p / m + l2 * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / m + l2 * np.eye(k)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    # the quantile with the fewest errors; of equally good ones the middle of the widest gap
    order = np.argsort(s)
    ss, yy = s[order], y[order]
    errors = np.concatenate(([0], np.cumsum(yy == 1))) + np.concatenate((np.cumsum((yy == 0)[::-1])[::-1], [0]))
    edges = np.concatenate(([ss[0] - 1], (ss[1:] + ss[:-1]) / 2, [ss[-1] + 1]))
    gap = np.concatenate(([0], np.diff(ss), [0]))
    best = np.flatnonzero(errors <= errors.min() + 0.002 * len(y))
    i = best[np.argmax(gap[best])]
    return {"w": w / std, "cut": float(edges[i] + (w / std) @ mean), "quantile": i / len(ss),
            "mean": mean, "std": std}


def score_column(model: dict):
    """Score expression over the feature array ``x``: logistic, 0.7 at the threshold."""
    if "mean" not in model:
        raw = F.lit(0.0)
        cut = model["cut"]
    else:
        w, mean, std = model["w"] * model["std"], model["mean"], model["std"]
        raw = F.lit(0.0)
        for i in range(len(w)):
            z = (F.col("x")[i] - float(mean[i])) / float(std[i])
            raw = raw + F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z)) * float(w[i])
        cut = model["cut"] - float(model["w"] @ mean)
    logit = raw - cut + float(np.log(THRESHOLD / (1 - THRESHOLD)))
    return 1 / (1 + F.exp(-logit))


def rank_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = 20_000) -> DataFrame:
    """(doc_id, score) of every document. ``labels`` (doc_id, label) holds the rows to learn from."""
    table = stage(document_features(docs), "quality-features")
    train = (labels.where(F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
                   .join(table, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_train))
    rows = train.select("x", "y").toPandas()
    x = np.array(rows["x"].tolist(), dtype=float).reshape(len(rows), len(FEATURES))
    model = fit(x, rows["y"].to_numpy())
    return table.select("doc_id", score_column(model).alias("score"))


def op9_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    fold = lambda c: F.pmod(F.crc32(F.col(c).cast("string")), F.lit(4))
    out = rank_quality(docs, labels.where(fold("doc_id") != 2))
    return out.select("doc_id", (fold("doc_id") == 2).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
