"""A chunk table that is written again and again: commits of whole partitions, and manifests that name the valid ones.

Rows stand in partitions by collection and a bucket of their source. A commit writes new files to a folder of its own and
then a manifest, a table of the (collection, bucket, commit) that are valid from now on and of the batches that are in. The
manifest counts once its write has succeeded, so a reader sees all of a commit or nothing, and files of older commits stay
until ``vacuum``. Appending adds a commit to the partitions that it touches; replacing writes the touched partitions anew.
A batch that is in already changes nothing, and one that failed half-way is written over.

One writer at a time: a commit that finds its manifest there fails. A null or empty collection is called unknown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from argosy.session import remove_folder

BUCKETS = 64
MANIFEST = "collection STRING, bucket INT, commit LONG, batch STRING"
PART = ["collection", "bucket"]


def _numbers(spark: SparkSession, folder: str, prefix: str) -> list[tuple[int, bool]]:
    """(n, written to its end) of the folders {prefix}{n}."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [x.getPath() for x in fs.listStatus(path) if x.getPath().getName().startswith(prefix)]
    done = lambda p: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted((int(p.getName()[len(prefix) :]), done(p)) for p in found)


def version(spark: SparkSession, path: str) -> int:
    """The latest commit; -1 if there is none."""
    return max((n for n, done in _numbers(spark, f"{path}/manifests", "v=") if done), default=-1)


def _manifest(spark: SparkSession, path: str, at: int) -> DataFrame:
    return spark.createDataFrame([], MANIFEST) if at < 0 else spark.read.schema(MANIFEST).parquet(f"{path}/manifests/v={at}")


def _schema(spark: SparkSession, folders: list[str], base: str) -> T.StructType:
    """The columns of some commits; a collection is a string even if it looks like a number."""
    found = spark.read.option("basePath", base).option("mergeSchema", True).parquet(*folders).schema
    kinds = {"collection": T.StringType(), "bucket": T.IntegerType(), "commit": T.LongType()}
    return T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in found])


def _rows(spark: SparkSession, path: str, at: int) -> DataFrame | None:
    """The valid rows with their bucket; None if nothing is stored."""
    valid = _manifest(spark, path, at).filter("batch IS NULL")
    commits = [r["commit"] for r in valid.select("commit").distinct().collect()]  # a number for each commit that still counts
    if not commits:
        return None
    base = f"{path}/data"
    folders = [f"{base}/commit={n}" for n in sorted(commits)]
    rows = spark.read.option("basePath", base).schema(_schema(spark, folders, base)).parquet(*folders)
    return rows.join(valid.select(*PART, "commit"), [*PART, "commit"], "left_semi").drop("commit")


def read(spark: SparkSession, path: str, at: int | None = None) -> DataFrame | None:
    """The rows as of the latest commit, or of commit ``at``; None if there are none."""
    rows = _rows(spark, path, version(spark, path) if at is None else at)
    return None if rows is None else rows.drop("bucket")


def _commit(chunks: DataFrame, path: str, batch: str | None, replace: bool) -> bool:
    spark, at = chunks.sparkSession, version(chunks.sparkSession, path)
    before = _manifest(spark, path, at)
    if batch is not None and not before.filter(F.col("batch") == batch).isEmpty():
        return False
    here = at + 1
    collection = F.coalesce(F.nullif(F.col("collection"), F.lit("")), F.lit("unknown"))
    new = chunks.withColumn("collection", collection).withColumn("bucket", F.pmod(F.xxhash64("source"), F.lit(BUCKETS)).cast("int"))
    out = new
    old = _rows(spark, path, at) if replace else None
    if old is not None:
        touched, sources = new.select(*PART).distinct(), new.select("collection", F.col("source").alias("_s")).distinct()
        kept = old.join(touched, PART, "left_semi").join(sources, (old["collection"] == sources["collection"]) & old["source"].eqNullSafe(sources["_s"]), "left_anti")
        out = kept.unionByName(new, allowMissingColumns=True)
    folder = f"{path}/data/commit={here}"
    out.repartition(*PART).write.mode("overwrite").partitionBy(*PART).parquet(folder)
    if _written(spark, folder):
        made = spark.read.option("basePath", f"{path}/data").schema("collection STRING, bucket INT, commit LONG").parquet(folder).select(*PART, F.lit(here).cast("long").alias("commit")).distinct()
    else:
        made = spark.createDataFrame([], MANIFEST).drop("batch")
    valid = before.filter("batch IS NULL").drop("batch")
    valid = valid.join(made.select(*PART), PART, "left_anti") if replace else valid
    batches = before.filter("batch IS NOT NULL").select("batch")
    if batch is not None:
        batches = batches.unionByName(spark.range(1).select(F.lit(batch).alias("batch")))
    whole = valid.unionByName(made).unionByName(batches, allowMissingColumns=True)
    # an unfinished manifest of a writer that died is written over; a finished one is another writer's
    mode = "overwrite" if (here, False) in _numbers(spark, f"{path}/manifests", "v=") else "error"
    whole.select("collection", "bucket", "commit", "batch").coalesce(1).write.mode(mode).parquet(f"{path}/manifests/v={here}")
    return True


def _written(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return any(x.getPath().getName().startswith("collection=") for x in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path))


def append(chunks: DataFrame, path: str, batch: str | None = None) -> bool:
    """Add chunks (collection, source, ...). False if the batch is in already."""
    return _commit(chunks, path, batch, False)


def replace(chunks: DataFrame, path: str, batch: str | None = None) -> bool:
    """All rows of the sources of ``chunks``, in their collections, give way to them; only the partitions of these sources are
    written. False if the batch is in already."""
    return _commit(chunks, path, batch, True)


def vacuum(spark: SparkSession, path: str) -> list[int]:
    """Remove older manifests and the commits that the latest does not name; their numbers."""
    at = version(spark, path)
    named = {r["commit"] for r in _manifest(spark, path, at).select("commit").distinct().collect()}
    for n, _ in _numbers(spark, f"{path}/manifests", "v="):
        if n < at:
            remove_folder(spark, f"{path}/manifests/v={n}")
    gone = [n for n, _ in _numbers(spark, f"{path}/data", "commit=") if n not in named and n <= at]
    for n in gone:
        remove_folder(spark, f"{path}/data/commit={n}")
    return gone
