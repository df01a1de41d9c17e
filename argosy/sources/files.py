"""Readers and writers of documents, metric tables and chunk tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argosy.functions import text as tx


def discover_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the .pdf and .txt files of a file or a folder (one level), by path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path).select("path", "length")
    return files.filter(F.lower("path").rlike(r"\.(pdf|txt)$")).orderBy("path")


def read_text_docs(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, doc_hash, text): whole files, cleaned; the hash is of a file's bytes, bytes that are no UTF-8 do not come
    into its text, and files without text are left out."""
    raw = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("source_file"), F.sha2("content", 256).alias("doc_hash"), F.make_valid_utf8(F.col("content").cast("string")).alias("raw"))
    return raw.select("source_file", "doc_hash", tx.clean_text(F.replace("raw", F.lit("\ufffd"), F.lit(""))).alias("text")).filter("text != ''")


def page_records(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, text, content_length): cleaned; blank pages go, numbers stay."""
    return pages.withColumn("text", tx.clean_text(F.col("text"))).filter("text != ''").withColumn("content_length", F.length("text"))


def searchable_docs(pages: DataFrame, sample: int = 5, min_words: int = 5) -> DataFrame:
    """(doc_id) of documents of whose first pages at least half (one at least) have enough words."""
    first = pages.filter(F.col("page_number") <= sample)
    good = F.count_if(F.size(tx.words(F.col("text"))) >= min_words)
    return first.groupBy("doc_id").agg(good.alias("good"), F.count("*").alias("n")).filter(F.col("good") >= F.greatest(F.lit(1), F.floor(F.col("n") / 2))).select("doc_id")


def read_metric_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("metric STRING, value DOUBLE").option("header", True).csv(path)


def seed_manifest(spark: SparkSession, rows: list[tuple[str, str, str, str]]) -> DataFrame:
    """(source_file, company, doc_type, period) from a caller's list."""
    return spark.createDataFrame(rows, "source_file STRING, company STRING, doc_type STRING, period STRING")


def index_chunks(docs: DataFrame, manifest: DataFrame, size: int = 120, overlap: int = 20) -> DataFrame:
    """Chunks of the documents (doc_id, source_file, text) that a manifest names: squashed, in word windows, with the section
    guess and the manifest's columns."""
    from argosy.operators.chunk import word_chunks

    named = docs.join(manifest, "source_file").withColumn("text", tx.squash(F.col("text")))
    return word_chunks(named, size, overlap).select("chunk_id", "doc_id", "chunk_index", "total_chunks", "company", "doc_type", "section", "source_file", "period", "text")


CHUNK_TABLE = "collection STRING, chunk_id STRING, doc_id STRING, chunk_index INT, company STRING, doc_type STRING, section STRING, source_file STRING, period STRING, text STRING"


def create_or_get(spark: SparkSession, name: str, schema: str = CHUNK_TABLE) -> DataFrame:
    """The collection's table, made empty if there is none yet."""
    if not spark.catalog.tableExists(name):
        spark.createDataFrame([], schema).write.format("parquet").saveAsTable(name)
    return spark.table(name)


def collection_names(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables() if t.tableType != "TEMPORARY")


def drop_collection(spark: SparkSession, name: str) -> bool:
    """Drop a collection's table; False if there is none."""
    found = spark.catalog.tableExists(name)
    if found:
        spark.sql("DROP TABLE IDENTIFIER(:name)", args={"name": name})
    return found


def collection_stats(chunks: DataFrame, model: str) -> DataFrame:
    """(collection, chunks, embedding_model): one row for each collection."""
    return chunks.groupBy("collection").agg(F.count("*").alias("chunks")).withColumn("embedding_model", F.lit(model))


def list_documents(docs: DataFrame) -> DataFrame:
    """Documents, the newest first, ties by id."""
    return docs.orderBy(F.desc("created_at"), "doc_id")


def chunk_total(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("chunks"))


def stored_pair(docs: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) as they are stored: documents with their status; chunks of processed ones with metadata, a JSON of
    source and length."""
    judged = with_status(docs)
    ok = chunks.join(judged.filter("status = 'processed'").select("doc_id"), "doc_id", "left_semi")
    return judged.select("doc_id", "source", "status"), ok.withColumn("metadata", F.to_json(F.struct("source", F.length("text").alias("length"))))


def write_json(metrics: DataFrame, path: str) -> None:
    """One JSON object a row, nulls included, as Spark writes them: a folder of files."""
    metrics.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_chunks(chunks: DataFrame, path: str) -> None:
    """Add chunks to the table at path, a folder for each collection."""
    chunks.write.mode("append").partitionBy("collection").parquet(path)


def replaced(existing: DataFrame, new: DataFrame, key: str = "source") -> DataFrame:
    """The table after all rows of the new rows' sources have given way to them."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def with_status(docs: DataFrame) -> DataFrame:
    """Add status: failed for a text without content, else processed."""
    return docs.withColumn("status", F.when(tx.strip(F.coalesce("text", F.lit(""))) == "", "failed").otherwise("processed"))


def ingest_manifest(docs: DataFrame, known: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, status, chunks, duplicates_skipped, error, seconds): one result row for each document.

    no_content (with an error text), duplicate or success; a document whose error column (where docs has one) is set has
    status error. seconds, to two digits, is that of docs, 0 where docs has none.
    """
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    seen = known.select("doc_hash").distinct().withColumn("_seen", F.lit(True))
    rows = docs.join(seen, "doc_hash", "left").join(n, "doc_id", "left")
    empty = tx.strip(F.coalesce("text", F.lit(""))) == ""
    failed = F.coalesce("error", F.lit("")) if "error" in docs.columns else F.lit("")
    status = F.when(failed != "", "error").when(empty, "no_content").when(F.col("_seen"), "duplicate").otherwise("success")
    seconds = F.bround(F.coalesce("seconds", F.lit(0.0)), 2) if "seconds" in docs.columns else F.lit(0.0)
    return rows.select(
        "doc_id",
        status.alias("status"),
        F.when(status == "success", F.coalesce("chunks", F.lit(0))).otherwise(0).cast("long").alias("chunks"),
        (status == "duplicate").alias("duplicates_skipped"),
        F.when(failed != "", failed).when(empty, "Document is empty or unreadable").otherwise("").alias("error"),
        seconds.alias("seconds"),
    )


def cascade_delete(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Child rows whose parent is not deleted."""
    return children.join(deleted.select(key).distinct(), key, "left_anti")


def validate_requests(requests: DataFrame, collections: DataFrame) -> DataFrame:
    """Add reason: why a (company, collection) request is refused; null if it is fine."""
    known = collections.select(F.col("collection").alias("_c")).distinct().withColumn("_known", F.lit(True))
    blank = lambda c: tx.strip(F.coalesce(c, F.lit(""))) == ""
    reason = F.when(blank("company"), "company is blank").when(blank("collection"), "collection is blank").when(F.col("_known").isNull(), "collection is unknown")
    return requests.join(known, F.col("collection") == F.col("_c"), "left").withColumn("reason", reason).drop("_c", "_known")
