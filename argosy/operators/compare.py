"""Comparison of companies metric by metric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def better(a: Column, b: Column, name_a: Column, name_b: Column) -> Column:
    """The name with the greater value; "Equal" on a tie and if either value is missing or not a number."""
    known = a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b)
    return F.when(known & (a > b), name_a).when(known & (b > a), name_b).otherwise(F.lit("Equal"))


def compare_two(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two (metric, value) tables side by side; repeated metrics multiply and null metrics meet each other."""
    x, y = a.select(F.col("metric"), F.col("value").alias("value_1")), b.select(F.col("metric").alias("_m"), F.col("value").alias("value_2"))
    both = x.join(y, F.col("metric").eqNullSafe(F.col("_m"))).drop("_m")
    return both.withColumn("winner", better(F.col("value_1"), F.col("value_2"), F.lit("Company 1"), F.lit("Company 2")))


def ranking(values: DataFrame) -> DataFrame:
    """For each metric and year: how many companies report it, the best and the worst, and the spread. One aggregation stands
    for all pairs."""
    v = values.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return v.groupBy("metric", "fy").agg(
        F.count("*").alias("companies"), F.max(F.struct("value", "company")).alias("b"), F.min(F.struct("value", "company")).alias("w")
    ).select("metric", "fy", "companies", F.col("b.company").alias("best"), F.col("b.value").alias("best_value"), F.col("w.company").alias("worst"), F.col("w.value").alias("worst_value"))


def compare_peers(values: DataFrame, target: str) -> DataFrame:
    """One company against every other for each metric and year that both report."""
    own = values.filter(F.col("company") == target).select("metric", "fy", F.col("value").alias("own"))
    rest = values.filter(F.col("company") != target).select("company", "metric", "fy", "value")
    both = rest.join(own, ["metric", "fy"])
    return both.withColumn("winner", better(F.col("own"), F.col("value"), F.lit(target), F.col("company")))


def compare_with_leader(values: DataFrame) -> DataFrame:
    """(company, metric, fy, value, leader, leader_value, winner): each company against the one that leads its metric and year,
    the first by name of equal ones. Every company meets one other, so nothing grows with the square of their number."""
    known = values.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    top = known.groupBy("metric", "fy").agg(F.max("value").alias("leader_value"))
    first = known.join(top, ["metric", "fy"]).filter("value = leader_value").groupBy("metric", "fy").agg(F.min("company").alias("leader"), F.first("leader_value").alias("leader_value"))
    return values.join(first, ["metric", "fy"]).withColumn("winner", better(F.col("value"), F.col("leader_value"), F.col("company"), F.col("leader")))


def long_form(compared: DataFrame) -> DataFrame:
    """(metric, series, value) of both value columns, for grouped bars."""
    return compared.select("metric", F.expr("stack(2, 'Company 1', value_1, 'Company 2', value_2) AS (series, value)"))
