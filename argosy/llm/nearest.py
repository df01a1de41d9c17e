"""Exact nearest neighbours by a block matrix join of int8 products.

Equal vectors collapse to one class first; a class carries its k + 1 smallest ids, more of which no result can hold, so
a group of copies costs one row on each side. Classes are dealt by hash to stripes of candidates and groups of queries;
each (stripe, group) is one task of bounded size, to which a stripe is sent once for each group and a group once for
each stripe. There vectors become int8 with a scale of their own, and products of tiles of them, exact in floating
point, give every inner product up to |q - q8||c| + |q8||c - c8|. A pair survives when its upper bound reaches the
lowest score that can still count; survivors are computed again in double precision and go to a heap for each query.
The best of each task are ranked once more by query, cut to k + 1 in each task before they move.

Nearness is the largest inner product, ties to the smaller id. Defined cases: a vector that is null, zero, or holds null
or non-finite entries, or has not the length that most candidates have takes no part; equal rows (id and vector) count
once; another row of the query's id is a candidate, its own is not; a null id is never a query, may be found, and comes
last of a tie; no candidates give no rows; other columns are left out.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argosy.llm.vectors import dimension, finite, matrix
from argosy.session import with_checkpoint_dir

K = 20
#: Most entries of a stripe of candidates and of a group of queries, and the fewest candidates that are worth a task.
STRIPE, GROUP, LEAST = 2**23, 2**20, 2_048
#: Queries and candidates of a tile, and survivors computed at once.
TILE_Q, TILE_C, AT_ONCE = 1_024, 4_096, 2**16
#: Share of the lengths by which bounds are widened for rounding.
SLACK = 1e-9


class Quantised:
    """int8 entries, scale, length of the vectors, of what the int8 stand for, and of the rest, of each row."""

    def __init__(self, x: np.ndarray) -> None:
        top = np.abs(x).max(axis=1, initial=0.0)
        self.scale = np.where(top > 0, top / 127, 1.0)
        self.entries = np.rint(x / self.scale[:, None]).astype(np.int8)
        stands = self.entries * self.scale[:, None]
        self.norm, self.stands, self.rest = (np.linalg.norm(a, axis=1) for a in (x, stands, x - stands))


def bounds(q: Quantised, c: Quantised, rows: slice, cols: slice, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The products of a tile and how far each can be from the true one."""
    about = (q.entries[rows].astype(kind) @ c.entries[cols].astype(kind).T) * q.scale[rows, None] * c.scale[None, cols]
    err = q.rest[rows, None] * c.norm[None, cols] + q.stands[rows, None] * c.rest[None, cols]
    return about, err + SLACK * q.norm[rows, None] * c.norm[None, cols]


def search(q: np.ndarray, c: np.ndarray, k: int) -> Iterator[list[tuple[float, int]]]:
    """For each row of q the k best (score, -row of c), best first."""
    kind = np.float32 if q.shape[1] * 127 * 127 < 2**24 else np.float64  # in which sums of int8 products are exact
    of_q, of_c = Quantised(q), Quantised(c)
    for a in range(0, len(q), TILE_Q):
        rows = slice(a, a + TILE_Q)
        heaps: list[list[tuple[float, int]]] = [[] for _ in range(len(q[rows]))]
        floor = np.full(len(heaps), -np.inf)
        for b in range(0, len(c), TILE_C):
            about, err = bounds(of_q, of_c, rows, slice(b, b + TILE_C), kind)
            if about.shape[1] >= k:
                floor = np.maximum(floor, np.partition(about - err, -k, axis=1)[:, -k])
            i, j = np.nonzero(about + err >= floor[:, None])
            for at in range(0, len(i), AT_ONCE):
                x, y = i[at : at + AT_ONCE], j[at : at + AT_ONCE]
                for score, n, m in zip(np.einsum("ij,ij->i", q[a + x], c[b + y]).tolist(), x.tolist(), y.tolist(), strict=True):
                    heap, found = heaps[n], (score, -b - m)
                    if len(heap) < k:
                        heapq.heappush(heap, found)
                    elif found > heap[0]:
                        heapq.heapreplace(heap, found)
            floor = np.maximum(floor, [h[0][0] if len(h) == k else -np.inf for h in heaps])
        yield from (sorted(h, reverse=True) for h in heaps)


def _items(df: DataFrame, vec_id: str, vector: str, kind: str) -> DataFrame:
    """(_id, _v): distinct usable rows; a zero has no sign."""
    v = F.transform(F.col(f"`{vector}`").cast(kind), lambda x: x + F.lit(0).cast(kind[6:-1]))
    return df.filter(finite(F.col(f"`{vector}`"))).select(F.col(f"`{vec_id}`").cast("long").alias("_id"), v.alias("_v")).filter(F.exists("_v", lambda x: x != 0)).distinct()


def nearest(candidates: DataFrame, queries: DataFrame, k: int = K, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest candidates of each row of ``queries``, from rank 1."""
    spark = with_checkpoint_dir(candidates.sparkSession)
    kinds = {dict(df.dtypes)[vector] for df in (candidates, queries)}
    kind = "array<float>" if kinds == {"array<float>"} else "array<double>"
    c = _items(candidates, vec_id, vector, kind)
    d = max(1, dimension(c, "_v"))
    c, q = (x.filter(F.size("_v") == d) for x in (c, _items(queries, vec_id, vector, kind).filter(F.col("_id").isNotNull())))

    sought = q.select("_v").distinct().select("_v", F.monotonically_increasing_id().alias("_q")).checkpoint()
    first = Window.partitionBy("_v").orderBy(F.col("_id").asc_nulls_last())
    few = c.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k + 1)
    classes = few.groupBy("_v").agg(F.sort_array(F.collect_list("_id")).alias("_ids"), F.bool_or(F.col("_id").isNull()).alias("_null"))
    classes = classes.join(sought, "_v", "left").checkpoint()

    n_c, n_q = classes.count(), sought.count()
    groups = max(1, math.ceil(n_q * d / GROUP))
    tasks = 2 * spark.sparkContext.defaultParallelism
    stripes = max(1, math.ceil(n_c * d / STRIPE), min(math.ceil(n_c / LEAST), math.ceil(tasks / groups)))
    deal = lambda n: F.pmod(F.xxhash64("_v", F.lit(5)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = sought.select("_q", "_v", deal(groups).alias("_group"), every(stripes).alias("_stripe"))
    right = classes.select("_q", "_v", "_ids", "_null", deal(stripes).alias("_stripe"), every(groups).alias("_group"))

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        ids = [x + [None] * null for x, null in zip(b["_ids"].to_pylist(), b["_null"].to_pylist(), strict=True)]
        last = lambda x: (x is None, x or 0)
        order = np.array(sorted(range(len(ids)), key=lambda i: last(ids[i][0])), np.int64)  # so that ties fall to the smaller id
        of_q, own = a["_q"].to_pylist(), b["_q"].to_pylist()
        out: list[list] = [[], [], [], []]
        if len(of_q) and len(ids):
            found = search(matrix(a["_v"].combine_chunks(), d), matrix(b["_v"].combine_chunks(), d)[order], k + 1)
            for q, best in zip(of_q, found, strict=True):
                items = [(-score, *last(x), x, own[at] == q) for score, m in best for at in [order[-m]] for x in ids[at]]
                for score, _, _, x, same in heapq.nsmallest(k + 1, items):
                    for to, value in zip(out, (q, x, -score, same), strict=True):
                        to.append(value)
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.bool_())
        return pa.table({n: pa.array(x, t) for n, x, t in zip(("_q", "_id", "score", "_own"), out, kinds, strict=True)})

    key = ["_stripe", "_group"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(tile, "_q long, _id long, score double, _own boolean")
    best = Window.partitionBy("_q").orderBy(F.desc("score"), F.col("_id").asc_nulls_last())
    found = found.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k + 1)
    lists = found.groupBy("_q").agg(F.sort_array(F.collect_list(F.struct("_n", "_id", "score", "_own"))).alias("_found"))
    each = q.join(sought, "_v").select(F.col("_id").alias("query_id"), "_q").join(lists, "_q")
    others = F.slice(F.filter("_found", lambda x: ~(x["_own"] & x["_id"].eqNullSafe(F.col("query_id")))), 1, k)
    return each.select("query_id", F.posexplode(others).alias("_at", "_x")).select("query_id", (F.col("_at") + 1).alias("rank"), F.col("_x._id").alias("vec_id"), F.col("_x.score").alias("score"))
