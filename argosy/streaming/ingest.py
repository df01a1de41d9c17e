"""Ingest of text files into a chunk store with all metadata columns: a folder in one call, or as a stream, each content once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from argosy.functions import text as tx
from argosy.operators.chunk import drop_known
from argosy.operators.company import company_names
from argosy.operators.layout import layout_chunks
from argosy.operators.metadata import chunk_metadata
from argosy.session import with_checkpoint_dir
from argosy.sources import files, store

SIZE, OVERLAP = 450, 100


def chunked(docs: DataFrame, collection: str, as_of_year: int, analysis_id: str = "", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """The layout chunks of (doc_hash, source, text) with all metadata columns, the company's name among them."""
    pages = docs.select(F.col("doc_hash").alias("doc_id"), F.lit(1).alias("page_number"), "text")
    chunks = layout_chunks(pages, size, overlap).withColumn("chunk_id", F.concat_ws("-", "doc_id", "chunk_index"))
    chunks = chunks.join(chunks.groupBy("doc_id").agg(F.count("*").cast("int").alias("total_chunks")), "doc_id")
    named = docs.withColumn("doc_id", F.col("doc_hash")).join(company_names(pages).select("doc_id", "company"), "doc_id")
    known = named.select("doc_id", "text", "company", "source", "doc_hash", F.lit(analysis_id).alias("analysis_id"), F.col("source").alias("path"))
    return chunk_metadata(chunks, known, as_of_year).withColumn("collection", F.lit(collection))


def ingest_folder(spark: SparkSession, folder: str, path: str, collection: str, as_of_year: int, analysis_id: str = "", force: bool = False, batch: str | None = None, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of the .txt files of a folder go to the store at ``path``; a result row for each file.

    A content that the collection holds is a duplicate and skipped; of files with one content the first by name counts.
    ``force`` takes all files, and the chunks of files of the same name give way to theirs.
    """
    docs = files.read_text_docs(spark, f"{folder}/*.txt").withColumnRenamed("source_file", "source").withColumn("doc_id", F.col("source"))
    held = store.read(spark, path)
    known = spark.createDataFrame([], "doc_hash STRING") if held is None or force else held.filter(F.col("collection") == collection).select("doc_hash").distinct()
    # the hashes before this ingest, as the result is read behind it
    with_checkpoint_dir(spark)
    known = known.checkpoint()
    new = docs if force else drop_known(docs, known)
    out = chunked(new.select("doc_hash", "source", "text"), collection, as_of_year, analysis_id, size, overlap)
    (store.replace if force else store.append)(out, path, batch)
    counts = layout_chunks(docs.select("doc_id", F.lit(1).alias("page_number"), "text"), size, overlap)
    return files.ingest_manifest(docs, known, counts)


def ingest_stream(spark: SparkSession, folder: str, path: str, checkpoint: str, collection: str = "stream", as_of_year: int = 2026, size: int = SIZE, overlap: int = OVERLAP) -> StreamingQuery:
    """New .txt files of a folder go to the store at ``path``, each content once.

    The hashes seen are the stream's state, by key, so no batch reads a table of them (with the RocksDB state store they need
    not fit into memory). A batch is one commit of the store under its number, so one that is run again changes nothing.
    """

    def put(batch: DataFrame, number: int) -> None:
        # the batch is read once and whole, even if it is in already, as the stream's state is written by reading it
        batch = batch.persist()
        try:
            batch.count()
            store.append(chunked(batch, collection, as_of_year, "", size, overlap), path, f"{checkpoint}#{number}")
        finally:
            batch.unpersist()

    raw = spark.readStream.format("binaryFile").schema("path STRING, modificationTime TIMESTAMP, length LONG, content BINARY").option("pathGlobFilter", "*.txt").load(folder)
    text = tx.clean_text(F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit("")))
    docs = raw.select(F.sha2("content", 256).alias("doc_hash"), F.element_at(F.split("path", "/"), -1).alias("source"), text.alias("text")).filter("text != ''")
    new = docs.dropDuplicates(["doc_hash"])
    return new.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
