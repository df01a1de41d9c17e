"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: White space of the word rule [^\x20\x09-\x0D]+, as a Java class.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def kept(df: DataFrame, keep: list[str] | None, made: list[str]) -> list[str]:
    """The columns that go on (all if keep is None) but for those that a result column replaces."""
    new = {c.lower() for c in made}
    return [c for c in (df.columns if keep is None else keep) if c.lower() not in new]


def row(columns: list[str]) -> Column:
    """The columns that go on, packed, so that none can clash with a working column."""
    return F.struct(*(F.col(f"`{c}`") for c in columns)) if columns else F.struct(F.lit(None).alias("_none"))


def unpacked(columns: list[str], of: str = "_row") -> list[Column]:
    return [F.col(f"{of}.`{c}`").alias(c) for c in columns]


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], list], fields: list[T.StructField], keep: list[str]) -> DataFrame:
    """Append columns that ``fn`` computes from each Arrow batch.

    ``keep`` names the input columns that go on; one that has the name of a new column is replaced
    by it. fn returns one list or Arrow array for each of ``fields``.
    """
    on = kept(df, keep, [f.name for f in fields])
    schema = T.StructType([df.schema[c] for c in on] + fields)
    types = to_arrow_schema(T.StructType(fields)).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(fn(batch), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in on] + made, names=on + [f.name for f in fields])

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The UTF-8 bytes of a text column; null becomes no bytes."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
