"""An inverted-file index of vectors: cells around centroids, probed by nearness, exact distances within.

Centroids come from k-means on a bounded sample; every vector is put into its nearest cell by one scan. A search sends a
query to its nearest cells by an equi-join on the cell and ranks what stands there by exact distance. Cells are a
partition column of a stored index, so the join reads only cells that some query names. ``exact`` adds all cells that
can still hold one of the k nearest: those whose centroid is no further than the k-th distance and the cell's radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from argosy.functions import hooks, plan
from argosy.functions import text as tx
from argosy.operators import retrieve, vector_blocks
from argosy.session import with_checkpoint_dir

#: Most vectors that centroids are fitted on, different ones and the first by hash, and most cells: what the driver holds.
SAMPLE, MOST_CELLS = 50_000, 4_096
ROUNDS = 12
#: Rows of a part of the sample: their number depends on the sample alone, as what k-means draws depends on it.
PART = 2_000
#: Rounding of distances: bounds are widened by this share.
SLACK = 1e-6
METRICS = ("l2sq", "cosine")


@dataclass
class Index:
    """vectors: vec_id, embedding, cell and what else the vectors carry. radii: the largest distance from a cell's centroid, once measured."""

    vectors: DataFrame
    centroids: np.ndarray
    radii: np.ndarray | None
    metric: str


def _placed(c: Column, metric: str) -> Column:
    """The vector whose plain distance orders like the metric: for cosine that of length 1."""
    if metric not in METRICS:
        raise ValueError(f"no index for metric {metric}")
    c = c.cast("array<double>")
    if metric == "l2sq":
        return c
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    # bound: where Spark doesn't see that they are the same for all entries, it makes vector and length again for each
    of = lambda v: tx.let(F.nullif(length(v), F.lit(0.0)), lambda n: F.transform(v, lambda x: x / n))
    return tx.let(c, of)


def _placed_rows(x: np.ndarray, metric: str) -> np.ndarray:
    """The same of rows, where Python has them: sums go by the entries' order, as in Spark."""
    if metric == "l2sq":
        return x
    with np.errstate(all="ignore"):
        return x / np.sqrt(vector_blocks.sums(x, x, lambda a, b: a * b))[:, None]


def _gaps(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Distances of each vector from each centroid."""
    if not len(centroids):
        return np.zeros((len(x), 0))
    square = (x * x).sum(axis=1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(axis=1)[None, :]
    return np.sqrt(np.maximum(square, 0))


def fit_centroids(vectors: DataFrame, cells: int, metric: str = "l2sq", sample: int = SAMPLE, seed: int = 1) -> np.ndarray:
    """k-means centres of the first ``sample`` different vectors by hash; fewer if there are fewer. Copies don't fill the sample."""
    some = vectors.filter("embedding IS NOT NULL").select("embedding").distinct().withColumn("h", F.xxhash64("embedding")).orderBy("h").limit(sample)
    some = some.select(array_to_vector(_placed(F.col("embedding"), metric)).alias("features"), "h").persist()
    try:
        n = some.count()
        if not n:
            return np.zeros((0, 0))
        spread = some if n <= PART else some.repartition(-(-n // PART), "h")  # a limit leaves one partition
        model = KMeans(k=max(2, min(cells, MOST_CELLS)), maxIter=ROUNDS, seed=seed, initMode="random", solver="row").fit(spread)  # the block solver fails where fewer centres than k are drawn
        return np.array(model.clusterCenters())
    finally:
        some.unpersist()


def build(vectors: DataFrame, cells: int, metric: str = "l2sq", sample: int = SAMPLE) -> Index:
    """The index of all ``vectors`` (vec_id, embedding, ...) whose embedding is not null."""
    centroids = fit_centroids(vectors, cells, metric, sample)

    @F.pandas_udf("cell int, gap double")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            gaps = _gaps(_placed_rows(np.stack(b.to_list()), metric), centroids) if len(b) else np.zeros((0, 1))
            cell = gaps.argmin(axis=1)
            yield pd.DataFrame({"cell": cell.astype(np.int32), "gap": gaps[np.arange(len(cell)), cell]})

    held = vectors.filter("embedding IS NOT NULL").withColumn("_at", nearest(F.col("embedding").cast("array<double>")))
    held = held.withColumns({"cell": F.col("_at.cell"), "gap": F.col("_at.gap")}).drop("_at")
    return Index(held, centroids, None, metric)


def measured(index: Index) -> Index:
    """The index with its vectors checkpointed and the radius of each cell, which an exact search needs."""
    with_checkpoint_dir(index.vectors.sparkSession)
    vectors = index.vectors.checkpoint()
    return Index(vectors, index.centroids, _radii(vectors, len(index.centroids)), index.metric)


def _radii(vectors: DataFrame, cells: int) -> np.ndarray:
    out = np.full(cells, -1.0)  # of cells without a vector
    for r in vectors.groupBy("cell").agg(F.max("gap").alias("radius")).collect():  # MOST_CELLS rows at most
        out[r["cell"]] = r["radius"]
    return out


def stored(index: Index, path: str) -> Index:
    """Write the cells below ``path`` and the centroids beside them; the index that reads them."""
    index.vectors.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    spark = index.vectors.sparkSession
    rows = [(i, [float(a) for a in c], index.metric) for i, c in enumerate(index.centroids)]
    spark.createDataFrame(rows, "cell int, centroid array<double>, metric string").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> Index:
    """The index stored below ``path``."""
    centres = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # MOST_CELLS rows at most
    vectors = spark.read.parquet(f"{path}/cells")
    return Index(vectors, np.array([r["centroid"] for r in centres]), _radii(vectors, len(centres)), centres[0]["metric"] if centres else METRICS[0])


def search(index: Index, queries: DataFrame, k: int, probes: int, exact: bool = False, equal: dict | None = None) -> DataFrame:
    """(query_id, vec_id, distance, rank): the k nearest of the vectors in the ``probes`` nearest cells of each query
    (query_id, q), or of all vectors if ``exact``; ties by vec_id. ``equal`` names columns and the values that they must have."""
    centroids, radii, metric, n = index.centroids, index.radii, index.metric, min(probes, len(index.centroids))
    held = retrieve.where(index.vectors, equal or {})
    asked, q = queries.filter("q IS NOT NULL"), F.col("q").cast("array<double>")

    def gaps(b: pd.Series) -> np.ndarray:
        return _gaps(_placed_rows(np.stack(b.to_list()), metric), centroids) if len(b) else np.zeros((0, 1))

    @F.pandas_udf("array<int>")
    def first(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([np.argsort(g, kind="stable")[:n].tolist() for g in gaps(b)])

    @F.pandas_udf("array<int>")
    def rest(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for b, reach in batches:
            out = []
            for g, r in zip(gaps(b), reach, strict=True):
                far = np.argsort(g, kind="stable")[n:]
                out.append(far[(radii[far] >= 0) & ((g - radii)[far] <= r * (1 + SLACK) + SLACK)].tolist())
            yield pd.Series(out)

    with_checkpoint_dir(held.sparkSession)

    def among(cells: DataFrame) -> DataFrame:
        # made once, as queries are read several times
        probed = cells.select("query_id", "q", "_cells").checkpoint().select("query_id", "q", F.explode("_cells").alias("cell"))
        pairs = vector_blocks.candidates(probed, held, k, metric, lambda x, y: retrieve.distance(metric, x, y), "cell")
        return retrieve.top_k(pairs, k, "query_id", -F.col("distance"), ["vec_id"])

    near = among(asked.withColumn("_cells", first(q)))
    if not exact:
        return near
    if radii is None:
        raise ValueError("an exact search needs the radii of a stored index")
    near = near.checkpoint()
    # the k-th distance as a plain distance of placed vectors; without k neighbours all cells are open
    kth = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("distance")).alias("_d"))
    reach = F.sqrt(F.col("_d") * (2 if metric == "cosine" else 1))
    open_ = asked.join(kth, "query_id", "left").withColumn("_cells", rest(q, F.coalesce(reach, F.lit(float("inf")))))
    both = near.drop("rank").unionByName(among(open_).drop("rank"))
    return retrieve.top_k(both, k, "query_id", -F.col("distance"), ["vec_id"])


def retrieve_by_embedding(questions: DataFrame, index: Index, model: PipelineModel, k: int, probes: int, exact: bool = False) -> DataFrame:
    """(qid, chunk_id, distance, rank): the k chunks of an index (vec_id is the chunk's id) whose embeddings are nearest to those of
    the questions (qid, sub_question) by the same ``model``. A question without a known token finds nothing. Questions of the
    same tokens, which have the same embedding, are searched for once."""
    with_checkpoint_dir(questions.sparkSession)
    asked = questions.select("qid", hooks.words(F.col("sub_question")).alias("text")).checkpoint()
    made = plan.fenced_filter(hooks.embed(asked.select("text").distinct(), model=model), F.exists("embedding", lambda x: x != 0))
    some = made.select(F.col("text").alias("query_id"), F.col("embedding").alias("q"))
    found = search(index, some, k, probes, exact).withColumnsRenamed({"query_id": "text", "vec_id": "chunk_id"})
    return asked.join(found, "text").select("qid", "chunk_id", "distance", "rank")
