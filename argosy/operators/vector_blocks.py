"""The nearest vectors of queries by products of blocks: matrices of some rows each, joined, of which one product gives all pairs.

Products give distances up to their rounding; pairs that may be among the k nearest by them are computed again, term by term in
the order of ``retrieve.distance``, so that distances and ties are those of the plain form. Each pair of blocks hands on k pairs
a query. Equal vectors of a block are held up to k times, as no more of them can be found.

What numpy can't hold (null entries, numbers that are not finite, vectors without length under cosine) is joined plainly; pairs
of different lengths have no distance and come last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most rows of a block of vectors and of queries, and most entries that a task holds before it hands blocks on.
ROWS, ASKED, HELD = 2_048, 512, 2**22
#: Share of the lengths by which bounds are widened for rounding.
SLACK = 1e-11


def _usable(v: Column, metric: str) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = fine & F.exists(v, lambda x: x != 0) if metric == "cosine" else fine
    return v.isNotNull() & F.coalesce(fine, F.lit(False))


def _places(ids: pa.Array) -> np.ndarray:
    """The place of each id in the order of ids, null first."""
    order = pc.sort_indices(ids, null_placement="at_start").to_numpy()
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def _first(groups: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the first k of their group; groups stand together."""
    new = np.r_[True, groups[1:] != groups[:-1]] if len(groups) else np.zeros(0, bool)
    at = np.arange(len(groups))
    return at - np.maximum.accumulate(np.where(new, at, 0)) < k


def _copies(ids: pa.Array, x: np.ndarray, k: int, cells: np.ndarray | None = None) -> np.ndarray:
    """The places of rows, without what stands behind the k first by id of equal vectors (of a cell)."""
    void = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel() if x.shape[1] else np.zeros(len(x))
    which = np.unique(void, return_inverse=True)[1].ravel()
    if cells is not None:
        which = np.unique(np.stack([which, cells]), axis=1, return_inverse=True)[1].ravel()
    order = np.lexsort((_places(ids), which))
    return order[_first(which[order], k)]


def _few_copies(ids: pa.Array, x: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray]:
    if x.shape[1]:
        order = _copies(ids, x, k)
        return ids.take(pa.array(order)), x[order]
    return ids, x


def _thinned(rows: DataFrame, k: int) -> DataFrame:
    """Rows (cell, id, v) without copies that can't be among the k first of a cell's equal vectors, as far as a batch shows: not
    all copies of a vector go to the task of their cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, ids, v = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
            offsets, values = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False)
            sizes, kept = np.diff(offsets), []
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = values[offsets[at][:, None] + np.arange(size)].reshape(len(at), size)
                kept.append(at[_copies(ids.take(pa.array(at)), x, k, cells[at])])
            yield batch.take(pa.array(np.sort(np.concatenate(kept)))) if kept else batch

    return rows.mapInArrow(run, rows.schema)


def packed(rows: DataFrame, most: int, copies: int | None = None) -> DataFrame:
    """(cell, ids, size, data) of rows (cell, id, v): blocks of a cell's vectors of one length."""
    id_type, entry = rows.schema["id"].dataType, rows.schema["v"].dataType.elementType
    kind = np.float32 if isinstance(entry, T.FloatType) else np.float64
    schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("size", T.IntegerType()), T.StructField("data", T.BinaryType())])

    def block(key: tuple[int, int], parts: list) -> Iterator[pa.RecordBatch]:
        ids, x = pa.concat_arrays([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        if copies is not None:
            ids, x = _few_copies(ids, x, copies)
        for a in range(0, len(ids), most):
            one = ids[a : a + most]
            listed = pa.ListArray.from_arrays(pa.array([0, len(one)], pa.int32()), one)
            columns = [pa.array([key[0]], pa.int32()), listed, pa.array([key[1]], pa.int32()), pa.array([x[a : a + most].tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        counts: dict[tuple[int, int], int] = {}
        entries = 0
        for batch in batches:
            cells, ids, v = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
            offsets, values = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False)
            sizes = np.diff(offsets)
            order = np.lexsort((sizes, cells))
            ends = np.flatnonzero((np.diff(cells[order]) != 0) | (np.diff(sizes[order]) != 0)) + 1
            for some in np.split(order, ends) if len(order) else []:
                key = (int(cells[some[0]]), int(sizes[some[0]]))
                x = values[offsets[some][:, None] + np.arange(key[1])].astype(kind, copy=False).reshape(len(some), key[1])
                held.setdefault(key, []).append((ids.take(pa.array(some)), x))
                counts[key] = counts.get(key, 0) + len(some)
                entries += x.size
                if counts[key] >= most:
                    yield from block(key, held.pop(key))
                    entries -= counts.pop(key) * key[1]
            if entries > HELD:
                for key, parts in held.items():
                    yield from block(key, parts)
                held, counts, entries = {}, {}, 0
        for key, parts in held.items():
            yield from block(key, parts)

    return rows.select("cell", "id", "v").mapInArrow(run, schema)


def sums(a: np.ndarray, b: np.ndarray, term) -> np.ndarray:
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += term(a[:, d], b[:, d])
    return out


def _exact(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    dot = lambda x, y: sums(x, y, lambda i, j: i * j)
    if metric == "l2sq":
        return sums(a, b, lambda i, j: (i - j) * (i - j))
    return 1 - dot(a, b) / np.sqrt(dot(a, a) * dot(b, b)) if metric == "cosine" else -dot(a, b)


def nearest(q: np.ndarray, v: np.ndarray, places: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of v, distance) of the k nearest, ties by place."""
    with np.errstate(all="ignore"):
        nq, nv = np.sqrt((q * q).sum(axis=1)), np.sqrt((v * v).sum(axis=1))
        about = q @ v.T
        if metric == "l2sq":
            about *= -2
            about += (nq * nq)[:, None]
            about += (nv * nv)[None, :]
            slack = SLACK * (nq + nv.max(initial=0.0)) ** 2
        elif metric == "cosine":
            about /= -nq[:, None]
            about /= nv[None, :]
            slack = np.full(len(q), SLACK)
        else:
            about *= -1
            slack = SLACK * nq * nv.max(initial=0.0)
        if len(v) > k:
            limit = np.partition(about, k - 1, axis=1)[:, k - 1] + slack
            i, j = np.nonzero(~(about > limit[:, None]))
        else:
            i, j = (x.ravel() for x in np.indices((len(q), len(v))))
        d = _exact(metric, q[i], v[j])
        order = np.lexsort((places[j], d, i))
        order = order[_first(i[order], k)]
    return i[order], j[order], d[order]


def _met(blocks: DataFrame, k: int, metric: str, kinds: tuple[type, type], schema: T.StructType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                cell = {c: batch.column(c)[n] for c in batch.schema.names}
                asked, ids = cell["q_ids"].values, cell["v_ids"].values
                places, sizes = _places(ids), (cell["q_size"].as_py(), cell["v_size"].as_py())
                if sizes[0] == sizes[1]:
                    q, v = (np.frombuffer(cell[c].as_buffer(), t).astype(np.float64).reshape(len(of), sizes[0]) for c, t, of in (("q_data", kinds[0], asked), ("v_data", kinds[1], ids)))
                    i, j, d = nearest(q, v, places, k, metric)
                    found = pa.array(d, pa.float64())
                else:
                    some = np.argsort(places)[:k]
                    i, j = np.repeat(np.arange(len(asked)), len(some)), np.tile(some, len(asked))
                    found = pa.nulls(len(i), pa.float64())
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(i)), ids.take(pa.array(j)), found], names=["query_id", "vec_id", "distance"])

    return blocks.mapInArrow(run, schema)


def candidates(queries: DataFrame, vectors: DataFrame, k: int, metric: str, plain, by: str | None = None) -> DataFrame:
    """(query_id, vec_id, distance), the k nearest of each query among them; queries: query_id, q; vectors: vec_id, embedding.
    ``by``: a column of both, whose equal values meet; all meet without. plain: the distance of two columns."""
    spark = vectors.sparkSession
    keys = [by] if by else []
    queries, vectors = queries.select(*keys, "query_id", "q"), vectors.select(*keys, "vec_id", "embedding")
    asked_for = lambda df, q: df.join(F.broadcast(q.select(by).distinct()), by, "left_semi") if by else df  # noqa: E731  as many as there are cells at most
    vectors = asked_for(vectors, queries)  # only cells that are asked for are packed
    cell = (F.col(by) if by else F.lit(0)).cast("int").alias("cell")
    good_q, good_v = _usable(F.col("q"), metric), _usable(F.col("embedding"), metric)

    def number(c: str, df: DataFrame) -> Column:
        return F.col(c) if df.schema[c].dataType == T.ArrayType(T.FloatType(), df.schema[c].dataType.containsNull) else F.col(c).cast("array<double>")

    q = queries.filter(good_q).select(cell, F.col("query_id").alias("id"), number("q", queries).alias("v"))
    v = vectors.filter(good_v).select(cell, F.col("vec_id").alias("id"), number("embedding", vectors).alias("v"))
    if by:
        q, v = q.repartition("cell"), _thinned(v, k).repartition("cell")
    kinds = tuple(np.float32 if isinstance(x.schema["v"].dataType.elementType, T.FloatType) else np.float64 for x in (q, v))
    named = lambda df, p: df.select("cell", *(F.col(c).alias(p + c) for c in ("ids", "size", "data")))
    q, v = named(packed(q, ASKED), "q_"), named(packed(v, ROWS, k), "v_")
    if by:
        both = v.join(q, "cell")
    else:
        tasks = spark.sparkContext.defaultParallelism
        both = v.repartition(2 * tasks).join(q.drop("cell").repartition(max(1, tasks // 4)))
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("vec_id", vectors.schema["vec_id"].dataType), T.StructField("distance", T.DoubleType())])
    met = _met(both.drop("cell"), k, metric, kinds, schema)
    pairs = lambda a, b: a.join(b, keys or None).select("query_id", "vec_id", plain(F.col("q"), F.col("embedding")).alias("distance"))
    odd = queries.filter(~good_q)
    return met.unionByName(pairs(vectors.filter(~good_v), queries)).unionByName(pairs(asked_for(vectors.filter(good_v), odd), odd))
