"""Vectors of a table as rows of a numpy matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True for an array that is not null and holds neither null nor a non-finite entry."""
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector.cast("array<double>"), lambda x: F.coalesce(real(x), F.lit(False))), F.lit(False))


def dimension(vectors: DataFrame, vector: str) -> int:
    """The length that most arrays have, the longer of two; 0 for none."""
    top = vectors.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return top["d"] if top else 0


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Arrays of d doubles as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), d)
