"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Entries are made whole numbers, floor(scale * c) + offset, so sums are exact, and rows are centred as (n * x - S) / n
before anything is multiplied. One pass over the centred rows makes both products of a step: u = X w for each row, and
the sum of X'u. Left vectors are not stored: each is X times a short vector that the driver knows, so U'p, which full
reorthogonalisation needs, is that short vector times the X'p which the pass has summed. The right vectors are
reorthogonalised twice. What the driver holds is d x steps numbers, whatever the number of rows. The singular values
and vectors of the small bidiagonal matrix give deviations and components.

Steps end when the wanted components have settled, after d at most. A product that vanishes (equal eigenvalues, fewer
directions than d) starts again from a new vector that is orthogonal to all before.

Defined cases: a vector that is null, or holds null or non-finite entries, or has not the length that most have is left
out; entries saturate at 2**53 when made whole; a deviation that no long holds is null; directions without variance are
no components, so one row, equal rows or an empty table give none; fewer dimensions than components give as many as
there are; null and repeated ids go on with their rows; an input column with the name of a result column is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from argosy.llm.common import kept, row, unpacked
from argosy.llm.vectors import dimension, finite, matrix

COMPONENTS = 32
SCALE, OFFSET = 64.0, 1_000_000
#: Rows of a block of the matrix.
BLOCK = 4096
#: A wanted triplet has settled when its residual is so small against the largest singular value.
SETTLED = 1e-14
_HALF = 2**26


@dataclass
class Model:
    """rows: number of vectors; sums: exact sums of each dimension; vectors: a component in each row, by falling variance."""

    rows: int
    sums: list[int]
    trace: float
    vectors: np.ndarray
    variances: np.ndarray
    steps: int

    @property
    def explained(self) -> list[float]:
        return [float(x) / self.trace for x in self.variances]


def whole(c: np.ndarray, scale: float, offset: int) -> np.ndarray:
    return np.clip(np.floor(scale * c), -(2.0**53), 2.0**53).astype(np.int64) + offset


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, which 64 bits hold whenever it is that small, whatever its parts wrap to."""
    with np.errstate(over="ignore"):
        return np.int64(n) * x - np.array([s % 2**64 for s in sums], np.uint64).astype(np.int64)


def deviation(y: np.ndarray) -> list[int | None]:
    """The exact sum of squares of each row; null beyond 64 bits."""
    rough = (y.astype(np.float64) ** 2).sum(axis=1)
    with np.errstate(over="ignore"):
        exact = (y * y).sum(axis=1)
    return [int(e) if r < 9.2e18 else (v if (v := sum(int(a) ** 2 for a in q)) < 2**63 else None) for e, r, q in zip(exact, rough, y, strict=True)]


def _vectors(df: DataFrame, vector: str) -> DataFrame:
    return df.filter(finite(F.col(f"`{vector}`"))).select(F.col(f"`{vector}`").cast("array<double>").alias("_v"))


def _sum_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> dict[int, float]:
    """fn makes an array of each partition; their sum by index. One row an index and partition is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = fn(batches)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(made))), pa.array(made)], names=["j", "x"])

    return {r["j"]: r["x"] for r in df.mapInArrow(run, "j long, x double").groupBy("j").agg(F.sum("x").alias("x")).collect()}


def _exact_sums(vectors: DataFrame, d: int, scale: float, offset: int) -> tuple[int, list[int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = whole(matrix(batch.column(0), d), scale, offset)
            n, high, low = n + len(x), high + (x // _HALF).sum(axis=0), low + (x % _HALF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 1)), pa.array(np.append(high, 0)), pa.array(np.append(low, n))], names=["j", "h", "l"])

    got = {r["j"]: r for r in vectors.mapInArrow(run, "j long, h long, l long").groupBy("j").agg(F.sum("h").alias("h"), F.sum("l").alias("l")).collect()}
    return (got[d]["l"], [got[j]["h"] * _HALF + got[j]["l"] for j in range(d)]) if got else (0, [0] * d)


def bidiagonalise(product: Callable[[np.ndarray], tuple[np.ndarray, float]], d: int, scale: float, wanted: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Singular values and right vectors (rows) of X. product(w) gives X'(X w) and the squared length of X w."""
    chance = np.random.default_rng(7)
    v_all, w_all, g_all = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))
    b = np.zeros((d, d))
    tiny = 1e-13 * scale

    def apart(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x - v_all @ (v_all.T @ x)
        return x

    v, beta, step = chance.normal(size=d), 0.0, 0
    v /= np.linalg.norm(v)
    while True:
        v_all = np.column_stack([v_all, v])
        w = v - (beta * w_all[:, -1] if step else 0.0)
        g, s = product(w)
        c = w_all.T @ g  # U'p, as U is X times w_all
        w, g = w - w_all @ c, g - g_all @ c
        alpha = np.sqrt(max(0.0, s - c @ c))
        if alpha <= tiny:
            alpha, w, g = 0.0, np.zeros(d), np.zeros(d)
        else:
            w, g = w / alpha, g / alpha
        w_all, g_all = np.column_stack([w_all, w]), np.column_stack([g_all, g])
        b[step, step] = alpha
        step += 1
        if step == d:
            break
        r = apart(g - alpha * v)
        beta = float(np.linalg.norm(r))
        if beta <= tiny:
            beta, r = 0.0, apart(chance.normal(size=d))
        elif step >= wanted:
            left, sigma, _ = np.linalg.svd(b[:step, :step])
            if (beta * np.abs(left[-1, :wanted]) <= SETTLED * sigma[0]).all():
                break
        v = r / np.linalg.norm(r)
        b[step - 1, step] = beta
    _, sigma, right = np.linalg.svd(b[:step, :step])
    return sigma, right @ v_all.T, step


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: float = SCALE, offset: int = OFFSET) -> Model:
    """The components of all usable vectors of ``df``."""
    v = _vectors(df, vector)
    d = dimension(v, "_v")
    none = Model(0, [0] * d, 0.0, np.zeros((0, d)), np.zeros(0), 0)
    if not d:
        return none
    v = v.filter(F.size("_v") == d)
    n, sums = _exact_sums(v, d, scale, offset)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = centred(whole(matrix(batch.column(0), d), scale, offset), n, sums) / n
            yield pa.RecordBatch.from_arrays([pa.array([y[i : i + BLOCK].tobytes() for i in range(0, len(y), BLOCK)], pa.binary())], names=["m"])

    x = v.mapInArrow(blocks, "m binary").persist(StorageLevel.MEMORY_AND_DISK)
    each = lambda batches: (np.frombuffer(m, np.float64).reshape(-1, d) for b in batches for m in b.column(0).to_pylist())
    try:
        total = _sum_rows(x, lambda batches: np.array([sum((float((m * m).sum()) for m in each(batches)), 0.0)]))[0]
        if total <= 0:
            return none

        def product(w: np.ndarray) -> tuple[np.ndarray, float]:
            def both(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
                out = np.zeros(d + 1)
                for m in each(batches):
                    u = m @ w
                    out[:d] += m.T @ u
                    out[d] += u @ u
                return out

            got = _sum_rows(x, both)
            return np.array([got[j] for j in range(d)]), got[d]

        sigma, right, steps = bidiagonalise(product, d, float(np.sqrt(total)), min(components, d))
    finally:
        x.unpersist()
    real = sigma[:components] > 1e-10 * sigma[0]
    right = right[:components][real]
    right *= np.sign(right[np.arange(len(right)), np.abs(right).argmax(axis=1)])[:, None]
    return Model(n, sums, total / n, right, sigma[:components][real] ** 2 / n, steps)


def whiten(df: DataFrame, model: Model, keep: list[str] | None = None, vector: str = "embedding", scale: float = SCALE, offset: int = OFFSET) -> DataFrame:
    """The usable rows of ``df`` with deviation (long, of n * x - S) and whitened (a number for each component)."""
    d, n, sums = len(model.sums), model.rows, model.sums
    by = model.vectors.T / np.sqrt(model.variances) if len(model.variances) else np.zeros((d, 0))
    on = kept(df, keep, ["deviation", "whitened"])
    rows = df.filter(finite(F.col(f"`{vector}`")) & (F.size(f"`{vector}`") == d) & F.lit(d > 0))
    rows = rows.select(row(on).alias("_row"), F.col(f"`{vector}`").cast("array<double>").alias("_v"))
    k = by.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = centred(whole(matrix(batch.column(1), d), scale, offset), n, sums)
            z = (y / max(n, 1)) @ by
            lists = pa.ListArray.from_arrays(np.arange(0, len(y) * k + 1, k or 1, dtype=np.int32) if k else np.zeros(len(y) + 1, np.int32), z.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation(y), pa.int64()), lists], names=["_row", "deviation", "whitened"])

    schema = T.StructType([rows.schema["_row"], T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(run, schema).select(*unpacked(on), "deviation", "whitened")


def identity_error(whitened: DataFrame, rows: int, components: int) -> float:
    """The largest absolute entry of the covariance of column whitened minus the identity."""
    k = components
    if not rows or not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((k + 1, k))
        for batch in batches:
            z = matrix(batch.column(0), k)
            out[:k] += z.T @ z
            out[k] += z.sum(axis=0)
        return out.ravel()

    got = _sum_rows(whitened.select("whitened"), run)
    out = np.array([got[j] for j in range(k * (k + 1))]).reshape(k + 1, k) / rows
    return float(np.abs(out[:k] - np.outer(out[k], out[k]) - np.eye(k)).max())
