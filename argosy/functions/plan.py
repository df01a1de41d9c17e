"""Helpers that shape a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fenced_filter(df: DataFrame, condition: Column) -> DataFrame:
    """A filter that stays above the columns that it reads.

    Spark pushes filters below projections by putting a column's expression in the place of each mention. Where the
    expression is long and mentioned often that computes it again and again; a column that is not deterministic stops it.
    """
    return df.withColumn("_fence", F.monotonically_increasing_id()).filter(condition & (F.col("_fence") >= 0)).drop("_fence")
