"""Report tables, chart series and text sections out of a wide metric table.

A report is about one row of ``wide``: company, fy and the columns of METRICS, any of them null, with industry,
business_model and market_position where there are any. Risks (company, fy, category, severity, description), peers (company,
fy, peer and figures), ratios (company, fy, ratios) and research (company, fy, question, answer, source) are tables of their
own, aggregated before they are joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BY = ["company", "fy"]
MISSING = "N/A"
TAKEAWAYS = 10
# Metric columns and their names, peers' columns and their names, charts of metric columns, levels of risks.
METRICS = [
    ("revenue", "Revenue"),
    ("net_profit", "Net Profit"),
    ("eps", "EPS"),
    ("operating_margin", "Operating Margin"),
    ("gross_margin", "Gross Margin"),
    ("ebitda", "EBITDA"),
    ("assets", "Assets"),
    ("liabilities", "Liabilities"),
    ("cash_flow", "Cash Flow"),
]
PEER_METRICS = [("revenue", "Revenue"), ("net_profit", "Net Profit"), ("operating_margin", "Operating Margin"), ("debt", "Debt"), ("cash_flow", "Cash Flow")]
CHARTS = [
    ("revenue", "revenue_profit", "Revenue"),
    ("net_profit", "revenue_profit", "Net Profit"),
    ("assets", "assets_liabilities", "Assets"),
    ("liabilities", "assets_liabilities", "Liabilities"),
    ("cash_flow", "cash_flow", "Cash Flow"),
]
LEVELS = ("Low", "Medium", "High")
# Ratios and what they mean.
RATIOS = [
    ("ROE", "Return on Equity measures how efficiently shareholder capital is used."),
    ("ROA", "Return on Assets measures how efficiently assets generate profit."),
    ("Current Ratio", "Measures the company's ability to meet short-term obligations."),
    ("Debt-to-Equity", "Indicates the level of financial leverage."),
    ("Profit Margin", "Shows how much profit is earned from each unit of revenue."),
    ("Operating Margin", "Measures operating efficiency before interest and taxes."),
]
# Sentences of a report.
NO_METRIC = "Information was not available in the source documents."
METRIC_ADVICE = "This metric should be analysed alongside historical performance and industry benchmarks to assess the company's financial health."
NO_RISK_FOUND = "No major financial risks were identified."
NO_RISK_DETECTED = "No major financial risks detected."
PROFITS = "Company is generating profits."
POSITIVE_CASH = "Positive cash flow supports operations."
RISKS_FOUND = "Financial risks have been identified."
BENCHMARKS = "Benchmarking against peers may identify growth opportunities."
CHANGING_MARKETS = "Changing market conditions may impact future financial performance."
OUTLOOK = (
    "This report provides an objective assessment of the company's financial position based on the available financial documents. "
    "The findings should be considered alongside broader market, industry, and economic factors. This report does not constitute investment advice."
)
ANALYSED = (
    " has been analysed using the report system. The report combines financial extraction, risk detection, "
    "company comparison, and research findings to provide an overall assessment of the organisation."
)
OVERALL = (
    "Overall, the financial information suggests that further evaluation of profitability, liquidity, financial risks and competitive "
    "positioning is required before drawing investment conclusions."
)
CONCLUSION = (
    "The financial information available for ",
    " has been successfully analysed using the report system. This report combines structured financial data, detected "
    "risks, company benchmarking and research findings into a single analyst-style document.\n\nThe results should be interpreted alongside "
    "industry trends, macroeconomic conditions and future company disclosures. This report is intended for educational and analytical purposes "
    "and does not constitute investment advice.",
)
UNKNOWN = "Information not available"
FURTHER = "Additional financial analysis recommended."


def _rows(wide: DataFrame, rows: list[Column]) -> DataFrame:
    return wide.select(*BY, F.inline(F.array_compact(F.array(*rows))))


def metrics_table(wide: DataFrame) -> DataFrame:
    """(company, fy, metric, value): nine rows, values as text, N/A where missing."""
    return _rows(wide, [F.struct(F.lit(name).alias("metric"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("value")) for c, name in METRICS])


def ratio_table(rated: DataFrame) -> DataFrame:
    """(company, fy, ratio, value): a row for each ratio, or one that says there is none."""
    rows = rated.select(*BY, F.explode_outer("ratios").alias("ratio", "value"))
    return rows.select(*BY, F.coalesce("ratio", F.lit("No Ratio Available")).alias("ratio"), F.coalesce(F.col("value").cast("string"), F.lit(MISSING)).alias("value"))


def ratios(wide: DataFrame) -> DataFrame:
    """(company, fy, ratios): a map of the known ratios that these figures give, cut to two digits; one by zero or of a missing
    figure is left out."""
    equity = F.col("assets") - F.col("liabilities")
    made = {"ROE": ("net_profit", equity), "ROA": ("net_profit", "assets"), "Debt-to-Equity": ("liabilities", equity), "Profit Margin": ("net_profit", "revenue")}
    cut = lambda x: (F.floor(x * 100) / 100).cast("decimal(20,2)")
    pairs = [F.struct(F.lit(k).alias("key"), cut(F.try_divide(F.col(a).cast("double"), (b if isinstance(b, Column) else F.col(b)).cast("double"))).alias("value")) for k, (a, b) in made.items()]
    pairs.append(F.struct(F.lit("Operating Margin").alias("key"), F.col("operating_margin").cast("decimal(20,2)").alias("value")))
    return wide.select(*BY, F.map_from_entries(F.filter(F.array(*pairs), lambda x: x["value"].isNotNull())).alias("ratios"))


def _or_none(wide: DataFrame, rows: DataFrame, none: dict[str, str]) -> DataFrame:
    """Each report's rows, or one row of fixed values where it has none."""
    marked = rows.withColumn("_has", F.lit(True))
    joined = wide.select(*BY).distinct().join(marked, BY, "left")
    return joined.select(*BY, *(F.when(F.col("_has"), F.col(c).cast("string")).otherwise(v).alias(c) for c, v in none.items()))


def risk_table(wide: DataFrame, risks: DataFrame) -> DataFrame:
    """(company, fy, category, severity, description): a report's risks, or a general row where it has none."""
    return _or_none(wide, risks.select(*BY, "category", "severity", "description"), {"category": "General", "severity": "Low", "description": NO_RISK_DETECTED})


def risk_assessment(wide: DataFrame, risks: DataFrame) -> DataFrame:
    """risk_table() with the words of the assessment's section."""
    return _or_none(wide, risks.select(*BY, "category", "severity", "description"), {"category": "General", "severity": "Low", "description": NO_RISK_FOUND})


def comparison_table(wide: DataFrame, peers: DataFrame) -> DataFrame:
    """(company, fy, peer and its five figures as text), or a row of dashes where a report has no peer."""
    return _or_none(wide, peers.select(*BY, "peer", *(c for c, _ in PEER_METRICS)), {"peer": "No Comparison Data"} | {c: "-" for c, _ in PEER_METRICS})


def research_table(wide: DataFrame, research: DataFrame) -> DataFrame:
    """(company, fy, question, answer, source), or a row that says there is none."""
    return _or_none(wide, research.select(*BY, "question", "answer", "source"), {"question": "No Research", "answer": "-", "source": "-"})


def commentary(wide: DataFrame) -> DataFrame:
    """(company, fy, no, metric, sentence): one sentence for each of the nine metrics."""
    say = lambda c, name: F.coalesce(F.concat(F.lit(f"{name}: Reported value is "), F.col(c).cast("string"), F.lit(f". {METRIC_ADVICE}")), F.lit(f"{name}: {NO_METRIC}"))
    return _rows(wide, [F.struct(F.lit(i).alias("no"), F.lit(name).alias("metric"), say(c, name).alias("sentence")) for i, (c, name) in enumerate(METRICS, 1)])


def ratio_commentary(rated: DataFrame) -> DataFrame:
    """(company, fy, no, ratio, sentence): one for each of the six known ratios, whether a report has it or not."""

    def say(name: str, meaning: str) -> Column:
        value = F.try_element_at("ratios", F.lit(name)).cast("string")
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(f"\nInterpretation: {meaning}")), F.lit(f"{name}: Information not available."))

    return _rows(rated, [F.struct(F.lit(i).alias("no"), F.lit(name).alias("ratio"), say(name, meaning).alias("sentence")) for i, (name, meaning) in enumerate(RATIOS, 1)])


def with_counts(wide: DataFrame, risks: DataFrame, peers: DataFrame, research: DataFrame) -> DataFrame:
    """Reports with n_risks, n_peers and n_research."""
    out = wide
    for name, rows in (("n_risks", risks), ("n_peers", peers), ("n_research", research)):
        out = out.join(rows.groupBy(*BY).agg(F.count("*").alias(name)), BY, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def swot(counted: DataFrame) -> DataFrame:
    """(company, fy, quadrant, statement) of with_counts(): any profit or cash flow but zero is a strength, a loss as well."""
    on = lambda c: F.coalesce(F.col(c) != 0, F.lit(False))
    say = lambda q, t, cond: F.when(cond, F.struct(F.lit(q).alias("quadrant"), F.lit(t).alias("statement")))
    rows = [
        say("Strengths", PROFITS, on("net_profit")),
        say("Strengths", POSITIVE_CASH, on("cash_flow")),
        say("Weaknesses", RISKS_FOUND, F.col("n_risks") > 0),
        say("Opportunities", BENCHMARKS, F.col("n_peers") > 0),
        say("Threats", CHANGING_MARKETS, F.lit(True)),
    ]
    return _rows(counted, rows)


def key_takeaways(counted: DataFrame) -> DataFrame:
    """(company, fy, no, takeaway) of with_counts(): what there is, filled up to TAKEAWAYS lines."""
    lines = [
        F.when(F.col("revenue").isNotNull(), "Revenue information successfully extracted."),
        F.when(F.col("net_profit").isNotNull(), "Profitability metrics are available."),
        F.when(F.col("n_risks") > 0, F.concat(F.col("n_risks").cast("string"), F.lit(" financial risks detected."))).otherwise("No significant financial risks detected."),
        F.when(F.col("n_peers") > 0, "Company comparison completed."),
        F.when(F.col("n_research") > 0, "Research findings include cited evidence."),
    ]
    padded = F.slice(F.concat(F.array_compact(F.array(*lines)), F.array_repeat(F.lit(FURTHER), TAKEAWAYS)), 1, TAKEAWAYS)
    return counted.select(*BY, F.posexplode(padded).alias("no", "takeaway")).withColumn("no", F.col("no") + 1)


def executive_summary(wide: DataFrame) -> DataFrame:
    """(company, fy, summary)."""
    money = lambda c: F.format_number(F.col(c).cast("double"), 2)
    parts = [
        F.concat(F.col("company"), F.lit(ANALYSED)),
        F.coalesce(F.concat(F.lit("\n\nThe company reported revenue of "), money("revenue"), F.lit(", indicating the scale of its operations.")), F.lit("")),
        F.coalesce(F.concat(F.lit(" Net profit of "), money("net_profit"), F.lit(" reflects overall profitability.")), F.lit("")),
        F.coalesce(F.concat(F.lit(" Operating margin of "), F.col("operating_margin").cast("string"), F.lit("% provides insight into operational efficiency.")), F.lit("")),
        F.lit(f"\n\n{OVERALL}"),
    ]
    return wide.select(*BY, F.concat(*parts).alias("summary"))


def company_overview(wide: DataFrame) -> DataFrame:
    """(company, fy, overview)."""
    known = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(UNKNOWN)) if c in wide.columns else F.lit(UNKNOWN)
    parts = [F.lit("Company Name: "), F.col("company"), F.lit("\n\nIndustry: "), known("industry"), F.lit("\n\nBusiness Model:\n"), known("business_model"), F.lit("\n\nMarket Position:\n"), known("market_position")]
    return wide.select(*BY, F.concat(*parts).alias("overview"))


def chart_series(wide: DataFrame, rated: DataFrame, risks: DataFrame, peers: DataFrame) -> DataFrame:
    """(company, fy, chart, label, value) behind the six charts: missing figures are 0, severities are filled up with zeros and
    others left out; a report without ratios or peers has no such chart."""
    number = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(20,2)")
    figures = _rows(wide, [F.struct(F.lit(chart).alias("chart"), F.lit(label).alias("label"), number(F.col(c)).alias("value")) for c, chart, label in CHARTS])
    of_ratios = rated.select(*BY, F.explode("ratios").alias("label", "v")).select(*BY, F.lit("ratios").alias("chart"), "label", number(F.col("v")).alias("value"))
    levels = risks.groupBy(*BY).agg(*(F.count_if(F.initcap("severity") == x).alias(x) for x in LEVELS))
    shown = wide.select(*BY).join(levels, BY, "left")
    of_risks = _rows(shown, [F.struct(F.lit("risk_distribution").alias("chart"), F.lit(x).alias("label"), number(F.col(x)).alias("value")) for x in LEVELS])
    of_peers = peers.select(*BY, F.lit("company_comparison").alias("chart"), F.col("peer").alias("label"), number(F.col("revenue")).alias("value"))
    return reduce(DataFrame.unionByName, [figures, of_ratios, of_risks, of_peers])


SECTIONS = [
    "Cover", "Contents", "Executive Summary", "Company Overview", "Financial Performance", "Financial Metrics", "Ratio Analysis", "Ratio Table", "Charts", "Risk Assessment",
    "Risk Table", "SWOT Analysis", "Company Comparison", "Research Findings", "Investment Outlook", "Key Takeaways", "Conclusion", "Appendix",
]


def sections(wide: DataFrame, rated: DataFrame, risks: DataFrame, peers: DataFrame, research: DataFrame, date: str) -> DataFrame:
    """(company, fy, section_no, section, body): the eighteen sections of each report in order.

    Every part gives lines with their place, of all sections in one table; one aggregation makes the bodies. The inputs are
    read several times, so a caller may want to checkpoint them.
    """
    counted = with_counts(wide, risks, peers, research)

    def lines(df: DataFrame, line: Column, order: list[str], name: str) -> DataFrame:
        words = F.array(*(F.col(c).cast("string") for c in order if c != "no")).cast("array<string>")
        no = F.col("no").cast("int") if "no" in order else F.lit(0)
        return df.select(*BY, F.lit(SECTIONS.index(name) + 1).alias("section_no"), F.struct(no.alias("no"), words.alias("words"), line.alias("line")).alias("at"))

    def fixed(body: Column, name: str, of: DataFrame = wide) -> DataFrame:
        return lines(of, body, [], name)

    cells = lambda *names: F.concat_ws(" | ", *names)
    peer_cells = ["peer", *(c for c, _ in PEER_METRICS)]
    charts = chart_series(wide, rated, risks, peers)
    alone = [
        ("Cover", F.concat_ws("\n", "company", F.lit(date))),
        ("Contents", F.lit("\n".join(f"{i}. {x}" for i, x in enumerate(SECTIONS[2:], 1)))),
        ("Investment Outlook", F.lit(OUTLOOK)),
        ("Conclusion", F.concat(F.lit(CONCLUSION[0]), F.col("company"), F.lit(CONCLUSION[1]))),
        ("Appendix", F.concat(F.lit("Figures of FY"), F.col("fy").cast("string"), F.lit("."))),
    ]
    one = lambda name, body: F.struct(F.lit(SECTIONS.index(name) + 1).alias("section_no"), F.struct(F.lit(0).alias("no"), F.array().cast("array<string>").alias("words"), body.alias("line")).alias("at"))
    parts = [
        wide.select(*BY, F.inline(F.array(*(one(name, body) for name, body in alone)))),
        fixed(F.col("summary"), "Executive Summary", executive_summary(wide)),
        fixed(F.col("overview"), "Company Overview", company_overview(wide)),
        lines(commentary(wide), F.col("sentence"), ["no"], "Financial Performance"),
        lines(metrics_table(wide).withColumn("no", F.array_position(F.array(*(F.lit(n) for _, n in METRICS)), F.col("metric"))), cells("metric", "value"), ["no"], "Financial Metrics"),
        lines(ratio_commentary(rated), F.col("sentence"), ["no"], "Ratio Analysis"),
        lines(ratio_table(rated), cells("ratio", "value"), ["ratio"], "Ratio Table"),
        lines(charts, cells("chart", "label", F.col("value").cast("string")), ["chart", "label"], "Charts"),
        lines(risk_assessment(wide, risks), cells("category", "severity", "description"), ["category", "severity", "description"], "Risk Assessment"),
        lines(risk_table(wide, risks), cells("category", "severity", "description"), ["category", "severity", "description"], "Risk Table"),
        lines(swot(counted), cells("quadrant", "statement"), ["quadrant", "statement"], "SWOT Analysis"),
        lines(comparison_table(wide, peers), cells(*peer_cells), ["peer"], "Company Comparison"),
        lines(research_table(wide, research), cells("question", "answer", "source"), ["question", "source"], "Research Findings"),
        lines(key_takeaways(counted), F.col("takeaway"), ["no"], "Key Takeaways"),
    ]
    whole = reduce(DataFrame.unionByName, parts).groupBy(*BY, "section_no").agg(F.array_sort(F.collect_list("at")).alias("x"))
    return whole.select(*BY, "section_no", F.element_at(F.array(*map(F.lit, SECTIONS)), F.col("section_no")).alias("section"), F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("body"))


def assembly(wide: DataFrame, rated: DataFrame, risks: DataFrame, peers: DataFrame, research: DataFrame) -> DataFrame:
    """One row a report: company, fy, extraction (a struct of the figures and the ratios), risks, peers, research (sorted
    arrays, empty where there is nothing)."""

    def listed(df: DataFrame, name: str, fields: list[str]) -> DataFrame:
        return df.groupBy(*BY).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))

    out = wide.join(rated, BY, "left").select(*BY, F.struct(F.col("company").alias("company_name"), *(c for c, _ in METRICS), F.col("ratios").alias("financial_ratios")).alias("extraction"))
    for df, name, fields in ((risks, "risks", ["category", "severity", "description"]), (peers, "peers", ["peer", *(c for c, _ in PEER_METRICS)]), (research, "research", ["question", "answer", "source"])):
        out = out.join(listed(df, name, fields), BY, "left").withColumn(name, F.coalesce(name, F.array()))
    return out
