"""Chunkers as table functions of SQL: SELECT * FROM word_windows(TABLE(docs), 450, 100).

The argument is any table with a column text; its other columns go on, with chunk_index and the chunk as text. They run in
Python workers, row by row; the DataFrame forms in operators.chunk stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from argosy.operators.chunk import wordsafe

TEXT = "text"


def word_pieces(text: str, size: int, overlap: int) -> list[str]:
    words = text.split()
    return [" ".join(words[i : i + size]) for i in range(0, len(words), size - overlap)]


def char_pieces(text: str, size: int, overlap: int) -> list[str]:
    return [text[i : i + size] for i in range(0, len(text), size - overlap)]


#: SQL name: how a text is cut.
FUNCTIONS = {"word_windows": word_pieces, "char_windows": char_pieces, "wordsafe_windows": wordsafe}


def table_function(cut: Callable[[str, int, int], list[str]]) -> type:
    class Chunker:
        @staticmethod
        def analyze(table: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
            names = table.dataType.fieldNames() if table.isTable else []
            if TEXT not in names:
                raise ValueError(f"the first argument must be a table with a column {TEXT}")
            if size.value is None or overlap.value is None or size.value <= overlap.value or overlap.value < 0:
                raise ValueError("size must be larger than overlap, and overlap not negative")
            on = [f for f in table.dataType.fields if f.name not in (TEXT, "chunk_index")]
            return AnalyzeResult(T.StructType([*on, T.StructField("chunk_index", T.IntegerType()), T.StructField(TEXT, T.StringType())]))

        def eval(self, row: T.Row, size: int, overlap: int) -> Iterator[tuple]:
            on = [row[c] for c in row.__fields__ if c not in (TEXT, "chunk_index")]
            for i, piece in enumerate(cut(row[TEXT], size, overlap) if row[TEXT] else []):
                yield (*on, i, piece)

    return Chunker


def register(spark: SparkSession) -> list[str]:
    """Register all of FUNCTIONS in the session; their names."""
    for name, cut in FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(table_function(cut)))
    return sorted(FUNCTIONS)
