"""Whitening of embeddings by singular values of the centred rows, without forming the covariance.

Entries are put on a grid (long x = floor(64 c) + 1000000). The fit list is each distinct x vector once.

1. Counts and sums of the fit list are exact integers, so a row is centred exactly: (n x - S) / n.
2. Blockwise QR: a task keeps one triangle R and folds its batches in (QR of R over the batch); the triangles of
   all tasks are stacked and factored again ``FAN`` at a time, until one is left. R'R = n V, V the covariance.
3. Householder reflections make R upper bidiagonal. Its singular values come from the differential quotient
   difference transform with shifts (dqds), which finds small ones to full relative accuracy.
4. Directions: for each wanted value the bidiagonal's tridiagonal square, less the value, is factored from the top
   (stationary transform) and from the bottom (progressive transform), and the two are joined where the twist is
   smallest; the vector follows from products alone. Values that nearly coincide get a common basis by inverse
   iteration with the same factors, turned to the singular directions by a small Rayleigh-Ritz step.
5. A second pass over the fit list measures how far the covariance of the whitened rows is from the identity.

Only R (dimensions squared), S and the directions pass through the driver.

Defined results: rows whose vector is null, holds null or non-finite entries or entries of 2**31 and more, or has
another length than most of the table's vectors (the longer in a tie) are dropped; equal vectors and equal ids
stay as rows of their own. Components whose singular value is under 1e-10 of the largest have no direction: there
are fewer than asked then, none for a fit list of one vector, and no row for an empty table. ``deviation`` is null
where it passes 64 bits. Extra columns stay, the added columns replace those of the same name.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.llm.shared import drop_stage, staged, text_batches

GRID, SHIFT = 64, 1_000_000
FAN = 16
EPS = float(np.finfo(np.float64).eps)
LEAST = 1e-10   # singular values under this share of the largest have no direction
CLOSE = 1e-5    # values nearer than this to their neighbour are treated together


# ---------------------------------------------------------------------------
# singular values and directions of a triangle


def bidiagonalize(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, P): U' r P is upper bidiagonal, by Householder reflections."""
    a = np.array(r, dtype=np.float64)
    n = a.shape[1]
    p = np.eye(n)

    def mirror(x):
        v = x.copy()
        size = np.linalg.norm(x)
        if size == 0 or not np.any(x[1:]):
            return None
        v[0] += math.copysign(size, x[0])
        return v / np.linalg.norm(v)

    for j in range(n):
        v = mirror(a[j:, j])
        if v is not None:
            a[j:, j:] -= 2.0 * np.outer(v, v @ a[j:, j:])
        if j < n - 2:
            v = mirror(a[j, j + 1:])
            if v is not None:
                a[j:, j + 1:] -= 2.0 * np.outer(a[j:, j + 1:] @ v, v)
                p[:, j + 1:] -= 2.0 * np.outer(p[:, j + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), p


def singular_squares(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix, largest first, by dqds.

    A sweep with shift t turns (q, e) into the factors of the matrix less t. Shifts stay below the smallest value:
    one that makes a pivot negative is taken back and quartered. The last entry is done when its coupling e is
    below rounding.
    """
    q, e = [float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in above]
    found, moved, guess = [], 0.0, 0.0
    while q:
        n = len(q)
        if n == 1 or e[-1] <= EPS * EPS * (moved + q[-1]) or q[-1] + moved == 0.0 == e[-1]:
            found.append(moved + q.pop())
            e = e[:n - 2]
            guess = 0.0 if not q else min(guess, min(q))
            continue
        shift = guess
        while True:
            qq, ee, d, low = [0.0] * n, [0.0] * (n - 1), q[0] - shift, math.inf
            for i in range(n - 1):
                low = min(low, d)
                qq[i] = d + e[i]
                ratio = q[i + 1] / qq[i] if qq[i] else 0.0
                ee[i] = e[i] * ratio
                d = d * ratio - shift if qq[i] else q[i + 1] - shift
            qq[-1] = d
            low = min(low, d)
            if low >= 0.0 or shift == 0.0:
                break
            shift = shift / 4.0 if shift > EPS * moved else 0.0
        q, e, moved = [max(x, 0.0) for x in qq], ee, moved + shift
        # near the end the last pivot falls to the smallest value from above, so nearly all of it can be taken off
        guess = low * (1.0 - 4.0 * math.sqrt(e[-1] / (low + e[-1]))) if low > 0.0 and e[-1] < low / 64.0 else low / 4.0
        guess = max(guess, 0.0)
    return np.sort(np.array(found))[::-1]


def _twisted(dd: np.ndarray, ll: np.ndarray, value: float, tiny: float):
    """Factors of L D L' - value from both ends: (stationary pivots, L+, progressive pivots, U-, twists)."""
    n = len(dd)
    dp, lp, s = np.empty(n), np.empty(n), np.empty(n)
    s[0] = -value
    for i in range(n):
        dp[i] = s[i] + dd[i] or tiny
        if i < n - 1:
            lp[i] = dd[i] * ll[i] / dp[i]
            s[i + 1] = lp[i] * ll[i] * s[i] - value
    dm, um, p = np.empty(n), np.empty(n), np.empty(n)
    p[-1] = dd[-1] - value
    for i in range(n - 2, -1, -1):
        dm[i + 1] = dd[i] * ll[i] ** 2 + p[i + 1] or tiny
        t = dd[i] / dm[i + 1]
        um[i] = ll[i] * t
        p[i] = p[i + 1] * t - value
    return dp, lp, dm, um, s + p + value


def directions(diagonal: np.ndarray, above: np.ndarray, squares: np.ndarray, wanted: int) -> np.ndarray:
    """Right singular vectors (columns) of the bidiagonal matrix for its ``wanted`` largest squares."""
    n = len(diagonal)
    top = math.sqrt(squares[0])
    tiny = squares[0] * EPS * EPS
    a = np.where(np.abs(diagonal) > top * EPS * EPS, diagonal, top * EPS * EPS)
    dd, ll = a * a, np.append(above / a[:-1], 0.0)
    out = np.zeros((n, wanted))
    rng = np.random.default_rng(7)
    i = 0
    while i < wanted:
        j = i + 1
        while j < n and squares[j - 1] - squares[j] <= CLOSE * squares[j - 1]:
            j += 1
        if j == i + 1:
            _, lp, _, um, twist = _twisted(dd, ll, squares[i], tiny)
            k = int(np.argmin(np.abs(twist)))
            z = np.zeros(n)
            z[k] = 1.0
            for x in range(k - 1, -1, -1):
                z[x] = -lp[x] * z[x + 1]
            for x in range(k, n - 1):
                z[x + 1] = -um[x] * z[x]
            basis = (z / np.linalg.norm(z))[:, None]
        else:
            value = squares[j - 1] * (1.0 - 4.0 * EPS * n)   # beside the values: no pivot vanishes
            dp, lp, *_ = _twisted(dd, ll, value, tiny)
            basis = np.linalg.qr(rng.standard_normal((n, j - i)))[0]
            for _ in range(4):
                for x in range(n - 1):
                    basis[x + 1] -= lp[x] * basis[x]
                basis /= dp[:, None]
                for x in range(n - 2, -1, -1):
                    basis[x] -= lp[x] * basis[x + 1]
                basis = np.linalg.qr(basis)[0]
            image = diagonal[:, None] * basis
            image[:-1] += above[:, None] * basis[1:]
            basis = basis @ np.linalg.eigh(image.T @ image)[1][:, ::-1]
        out[:, i:min(j, wanted)] = basis[:, :min(j, wanted) - i]
        i = j
    return out


def principal(r: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(unit eigenvectors as columns, eigenvalues, trace) of r'r / n, largest first, at most ``components``."""
    diagonal, above, p = bidiagonalize(r)
    squares = singular_squares(diagonal, above)
    rank = int((squares > squares[0] * LEAST ** 2).sum()) if len(squares) and squares[0] > 0 else 0
    wanted = min(components, rank)
    vectors = p @ directions(diagonal, above, squares, wanted) if wanted else np.zeros((len(r), 0))
    return vectors, squares[:wanted] / n, float(squares.sum() / n)


# ---------------------------------------------------------------------------
# passes


def grid_vectors(table: DataFrame, vector: str) -> DataFrame:
    """``table`` with ``_x``, the grid vector; rows without a usable vector are dropped."""
    usable = F.col(vector).isNotNull() & F.forall(vector, lambda c: F.coalesce(
        c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float(2**31))), F.lit(False)))
    x = table.where(usable).withColumn("_x", F.transform(
        vector, lambda c: F.floor(c.cast("double") * F.lit(float(GRID))) + F.lit(SHIFT).cast("long")))
    size = x.groupBy(F.size("_x").alias("k")).count().orderBy(F.desc("count"), F.desc("k")).first()
    return x.where(F.size("_x") == F.lit(size[0] if size else -1))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


class Centre:
    """Exact centring of grid rows by the count ``n`` and the sums ``s`` of the fit list."""

    def __init__(self, n: int, s: list[int]):
        self.n, self.s = n, s
        self.far = max([abs(v) for v in s], default=0) + n * (2**38)   # |n x| and |S| stay below

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S; exact integers unless they could pass 64 bits."""
        if self.far < 2**62:
            return self.n * x - np.array(self.s, dtype=np.int64)
        return self.n * x.astype(object) - np.array(self.s, dtype=object)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(np.float64) / self.n

    def squares(self, x: np.ndarray) -> list:
        y = self.deviations(x)
        size = (y.astype(np.float64) ** 2).sum(axis=1)
        if len(size) and size.max() < 2.0**62:
            return np.square(y).sum(axis=1).tolist()
        exact = [sum(int(v) ** 2 for v in row) for row in y]
        return [v if v < 2**63 else None for v in exact]


def fit_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each dimension."""
    def run(batches):
        total, n = np.zeros(d, dtype=object), 0
        for batch in batches:
            x = _matrix(batch.column(0), d)
            total += x.sum(axis=0).astype(object)
            n += len(x)
        for i in range(d):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([str(total[i])]), pa.array([n])],
                                             names=["i", "s", "n"])

    part = fit.select("_x").mapInArrow(run, "i int, s string, n long")
    rows = part.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()
    rows.sort(key=lambda r: r.i)
    return (int(rows[0].n), [int(r.s) for r in rows]) if rows else (0, [])


def triangle(fit: DataFrame, d: int, centre: Centre) -> np.ndarray:
    """R of the centred fit list: one triangle per task, stacked and factored again until one is left."""
    def fold(r, rows):
        return np.linalg.qr(np.vstack((r, rows)), mode="r")

    def run(batches):
        r = np.zeros((0, d))
        for batch in batches:
            r = fold(r, centre.rows(_matrix(batch.column(0), d)))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([r.tobytes()])],
                                             names=["part", "r"])

    def join(key, frame):
        r = np.zeros((0, d))
        for x in frame.sort_values("part")["r"]:
            r = fold(r, np.frombuffer(x).reshape(-1, d))
        return pd.DataFrame({"part": [key[0]], "r": [r.tobytes()]})

    parts, path = staged(fit.select("_x").mapInArrow(run, "part long, r binary"), "whiten-r")
    while parts.count() > 1:
        merged = parts.groupBy(F.floor(F.col("part") / FAN).alias("to")).applyInPandas(join, "part long, r binary")
        old = path
        parts, path = staged(merged, "whiten-r")
        drop_stage(fit.sparkSession, old)
    r = np.frombuffer(bytes(parts.first().r)).reshape(-1, d)
    drop_stage(fit.sparkSession, path)
    return np.vstack((r, np.zeros((d - len(r), d))))


def identity_error(fit: DataFrame, d: int, centre: Centre, project: np.ndarray) -> float:
    """Largest absolute entry of the covariance of the whitened fit list, minus the identity."""
    m = project.shape[1]

    def run(batches):
        total, gram = np.zeros(m), np.zeros((m, m))
        for batch in batches:
            w = centre.rows(_matrix(batch.column(0), d)) @ project
            total += w.sum(axis=0)
            gram += w.T @ w
        i, j = np.indices((m, m + 1)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                                          pa.array(np.hstack((gram, total[:, None])).ravel())], names=["i", "j", "v"])

    sums = np.zeros((m, m + 1))
    for r in fit.select("_x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        sums[r.i, r.j] = r.v
    mean = sums[:, m] / centre.n   # rounding only: the rows are centred already
    return float(np.abs(sums[:, :m] / centre.n - np.outer(mean, mean) - np.eye(m)).max())


ADDED = ("n", "deviation", "whitened", "explained", "identity_error")


def whiten(table: DataFrame, vector: str = "embedding", components: int = 16) -> DataFrame:
    """``table`` with n, deviation, whitened and explained (arrays over the components) and identity_error."""
    spark = table.sparkSession
    text_batches(spark)
    keep = [c for c in table.columns if c not in ADDED]
    base = table.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(keep)], F.col(vector).alias("_v"))
    rows, _ = staged(grid_vectors(base, "_v").drop("_v"), "whiten-rows")
    fit, path = staged(rows.select("_x").distinct(), "whiten-fit")
    first = fit.select(F.size("_x")).first()
    d = first[0] if first else 0
    names = [f"_c{i}" for i in range(len(keep))]
    n, s = fit_sums(fit, d) if d else (0, [])
    centre = Centre(n, s)
    vectors, values, trace = principal(triangle(fit, d, centre), n, components) if d else (np.zeros((0, 0)), [], 0.0)
    project = vectors / np.sqrt(values) if len(values) else np.zeros((d, 0))
    error = identity_error(fit, d, centre, project) if len(values) else 0.0
    share = [float(v / trace) for v in values]
    drop_stage(spark, path)
    src = rows.select(*names, "_x")
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("n", T.LongType()),
                           T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(len(names)), d) if d else np.zeros((batch.num_rows, 0), dtype=np.int64)
            w = centre.rows(x) @ project if d else np.zeros((len(x), 0))
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in range(len(names))], pa.array([centre.n] * len(x), pa.int64()),
                 pa.array(centre.squares(x), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(w.ravel()))],
                names=schema.names)

    out = src.mapInArrow(run, schema)
    return out.select(*[F.col(x).alias(c) for x, c in zip(names, keep)], "n", "deviation", "whitened",
                      F.lit(share).cast("array<double>").alias("explained"), F.lit(error).alias("identity_error"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    long = out.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")))
    return long.select("vec_id", (F.col("pos") + 1).cast("int").alias("component"), "n", "deviation",
                       F.col("col.whitened").alias("whitened"), F.col("col.explained").alias("explained"), "identity_error")
