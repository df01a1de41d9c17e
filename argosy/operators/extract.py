"""Metric values out of texts, and their trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argosy.functions import tags

STATEMENT = r"([A-Z][A-Za-z\-]*(?: [A-Z][A-Za-z\-]*)*): \$?([0-9][0-9,]*(?:\.[0-9]+)?) ?(thousand|million|billion|%)? ?\(FY([0-9]{4})\)"
UNITS = {"thousand": 1e3, "million": 1e6, "billion": 1e9}
NOT_FOUND = "Not Found"
# The labels of a labelled report, and (metric, pattern) of values in running text.
LABELS = [
    ("Company", r"Company:\s*(.*)"),
    ("Revenue", r"Revenue:\s*(.*)"),
    ("Net Income", r"Net Income:\s*(.*)"),
    ("Total Assets", r"Total Assets:\s*(.*)"),
    ("Total Liabilities", r"Total Liabilities:\s*(.*)"),
    ("Cash Flow", r"Cash Flow from Operations:\s*(.*)"),
    ("EPS", r"Earnings Per Share \(EPS\):\s*(.*)"),
]
VALUES = [
    ("Revenue", r"\$([\d.,]+)\s*billion.*?revenue"),
    ("Operating Income", r"\$([\d.,]+)\s*billion.*?operating income"),
    ("Net Income", r"net income.*?\$([\d.,]+)"),
    ("Assets", r"total assets.*?\$([\d.,]+)"),
    ("Liabilities", r"total liabilities.*?\$([\d.,]+)"),
    ("Cash Flow", r"cash flow.*?\$([\d.,]+)"),
    ("EPS", r"earnings per share.*?([\d.]+)"),
]


def statement_values(docs: DataFrame) -> DataFrame:
    """(..., metric, fy, amount, unit, value): every "Label: $amount unit (FYyyyy)" of the texts; value is scaled by the unit."""
    parts = F.arrays_zip(*(F.regexp_extract_all(F.col("text"), F.lit(STATEMENT), g).alias(n) for g, n in ((1, "metric"), (2, "amount"), (3, "unit"), (4, "fy"))))
    rows = docs.select(*(c for c in docs.columns if c != "text"), F.explode(parts).alias("p"))
    amount = F.expr("try_cast(replace(p.amount, ',', '') AS double)")
    unit = F.nullif(F.col("p.unit"), F.lit(""))
    scale = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv)), F.coalesce(unit, F.lit("-"))), F.lit(1.0))
    return rows.select(*(c for c in docs.columns if c != "text"), F.col("p.metric").alias("metric"), F.col("p.fy").cast("int").alias("fy"), amount.alias("amount"), unit.alias("unit"), (amount * scale).alias("value"))


def metric_trend(values: DataFrame) -> DataFrame:
    """One value for each company, metric and year, with the change from the year before in the table and a direction."""
    one = values.groupBy("company", "metric", "fy").agg(F.max("value").alias("value"))
    w = Window.partitionBy("company", "metric").orderBy("fy")
    before = F.lag("value").over(w)
    d = one.withColumn("previous", before)
    change = F.try_divide(F.col("value") - F.col("previous"), F.abs("previous"))
    way = F.when(F.col("previous").isNull(), "first").when(F.col("value") > F.col("previous"), "rising").when(F.col("value") < F.col("previous"), "falling").otherwise("flat")
    return d.withColumns({"change": change, "direction": way})


def labelled_metrics(reports: DataFrame, labels: list[tuple[str, str]] = LABELS) -> DataFrame:
    """(..., metric, value): the first value of each label of a report, "Not Found" if there is none."""
    found = F.array(*(F.struct(F.lit(m).alias("metric"), F.when(F.col("text").rlike("(?d)" + p), F.trim(F.regexp_extract("text", "(?d)" + p, 1))).otherwise(NOT_FOUND).alias("value")) for m, p in labels))
    return reports.select(*(c for c in reports.columns if c != "text"), F.inline(found))


def tagged_metrics(chunks: DataFrame, rules: list[tuple[str, str]] = VALUES, exact: bool = False) -> DataFrame:
    """(company, metric, value): for each rule the value in the company's first chunk (by chunk_order) that carries the tag
    and matches. A tag is carried if it is part of the chunk's CSV tags (exact: one of them)."""
    low = F.lower("financial_metrics")
    has = (lambda m: F.array_contains(F.split(low, ","), m.lower())) if exact else (lambda m: F.contains(low, F.lit(m.lower())))
    hit = lambda m, p: F.when(has(m) & F.col("text").rlike("(?iu)" + p), F.trim(F.regexp_extract("text", "(?iu)" + p, 1)))
    rows = chunks.select("company", "chunk_order", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), hit(m, p).alias("value")) for m, p in rules))))
    best = rows.groupBy("company", "metric").agg(F.min_by("value", F.when(F.col("value").isNotNull(), F.col("chunk_order"))).alias("value"))
    return best.withColumn("value", F.coalesce("value", F.lit(NOT_FOUND)))


def company_metrics_wide(values: DataFrame, metrics: list[str]) -> DataFrame:
    """One row for each company, a column for each metric (the latest year's value)."""
    latest = values.groupBy("company", "metric").agg(F.max_by("value", "fy").alias("value"))
    return latest.groupBy("company").pivot("metric", metrics).agg(F.first("value"))


def with_tags(chunks: DataFrame) -> DataFrame:
    """Chunks with financial_metrics, semantic_tags, report_type and the heading's section_title and section_type."""
    c = F.col("text")
    head = tags.section_heading(c)
    return chunks.withColumns({"financial_metrics": tags.financial_metrics(c), "semantic_tags": tags.semantic_tags(c), "report_type": tags.report_type(c), "section_title": head["title"], "section_type": head["type"], "block_type": tags.block_type(c)})
