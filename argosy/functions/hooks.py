"""Places for a caller's own models: page readers, text generators, embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = 1 << 10


def read_pages(files: DataFrame, reader: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, page_number, text) from binaryFile rows (path, content); reader gives the text of each page of one file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, i, t) for p, c in zip(b["path"], b["content"], strict=True) for i, t in enumerate(reader(c), 1)]
            yield pd.DataFrame(rows, columns=["path", "page_number", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, page_number int, text string")


def generate(prompts: DataFrame, generator: Callable[[list[str]], list[str]], out: str = "answer") -> DataFrame:
    """Prompts (..., prompt) with the generator's answers; it gets a batch of prompts at a time."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(generator(b.tolist()))

    return prompts.withColumn(out, F.pandas_udf(run, "string")("prompt"))


def fit_embedding(texts: DataFrame, features: int = FEATURES) -> PipelineModel:
    """The default embedding of texts (..., text): hashed token counts, weighted by their rarity over ``texts``, of length 1.

    What it learns is a weight for each feature; save() and load() keep it, so that questions are weighed like chunks.
    """
    from pyspark.ml.feature import IDF, HashingTF, Normalizer

    steps = [HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=features), IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="_v")]
    return Pipeline(stages=steps).fit(_tokens(texts))


def _words(c: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), 0), F.array().cast("array<string>"))


def _tokens(texts: DataFrame) -> DataFrame:
    return texts.withColumn("_tokens", _words(F.col("text")))


def words(c: Column) -> Column:
    """What the default embedding reads of a text; equal words have equal embeddings."""
    return F.array_join(_words(c), " ")


def embed(chunks: DataFrame, features: int = FEATURES, model: PipelineModel | None = None) -> DataFrame:
    """Chunks with the default embedding (0 for an empty text), fitted on them if no model is given."""
    from pyspark.ml.functions import vector_to_array

    made = (model or fit_embedding(chunks, features)).transform(_tokens(chunks))
    return made.withColumn("embedding", vector_to_array("_v", "float32")).drop("_tokens", "_tf", "_idf", "_v")


def embed_with(chunks: DataFrame, model: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """Chunks with the embeddings of a caller's model; it gets a batch of texts at a time."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(model(b.fillna("").tolist()))

    return chunks.withColumn("embedding", F.pandas_udf(run, "array<float>")("text"))
