"""Registered report queries over the figures of filings, and their SQL twins for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from argosy.operators import extract, redflag, report
from argosy.plans.filings import FIGURES_ORACLE, ORACLE, figures, filings
from argosy.session import table, with_checkpoint_dir

DATE = "01 January 2026"
PEERS = 3


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return figures(spark, sf_dir)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings with the year that they are about."""
    return filings(spark, sf_dir).select(F.col("filing_id").alias("doc_id"), "company", (F.col("filing_id") % 10000).cast("int").alias("fy"), "text")


def risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risks_of(docs(spark, sf_dir))


def risks_of(filed: DataFrame) -> DataFrame:
    """The red flags of each filing; a row that says there is none is no risk."""
    return redflag.rule_flags(filed).filter("category != 'general'").select("company", "fy", "category", "severity", "description")


def peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peers_of(wide(spark, sf_dir), table(spark, sf_dir, "supplier"))


def peers_of(figured: DataFrame, suppliers: DataFrame) -> DataFrame:
    """The PEERS suppliers with most revenue in a supplier's nation and year, but itself."""
    nation = suppliers.select(F.col("s_suppkey").cast("long").alias("suppkey"), F.col("s_nationkey").alias("nation"))
    all_ = figured.join(nation, "suppkey")
    w = Window.partitionBy("nation", "fy").orderBy(F.desc("revenue"), "company")
    best = all_.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= PEERS)
    best = best.select("nation", "fy", F.col("company").alias("peer"), "revenue", "net_profit", "operating_margin", F.col("liabilities").alias("debt"), "cash_flow")
    return all_.select("company", "fy", "nation").join(best, ["nation", "fy"]).filter("company != peer").drop("nation")


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.ratios(wide(spark, sf_dir))


def research(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research_of(docs(spark, sf_dir))


def research_of(filed: DataFrame) -> DataFrame:
    """What a filing says about the year before it."""
    v = extract.statement_values(filed.withColumnRenamed("fy", "own")).filter("fy < own")
    said = F.concat(F.col("metric"), F.lit(" of FY"), F.col("fy").cast("string"), F.lit(" is reported."))
    return v.select("company", F.col("own").alias("fy"), F.concat(F.lit("What was "), F.col("metric"), F.lit(" before?")).alias("question"), said.alias("answer"), F.concat("doc_id", F.lit(".txt")).alias("source"))


def inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """wide, rated, risks, peers and research, from figures, filings and peers that are made once."""
    with_checkpoint_dir(spark)
    w, d = wide(spark, sf_dir).checkpoint(), docs(spark, sf_dir).checkpoint()
    return w, report.ratios(w), risks_of(d), peers_of(w, table(spark, sf_dir, "supplier")).checkpoint(), research_of(d)


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, _, *rest = inputs(spark, sf_dir)
    return report.with_counts(w, *rest)


def report_metrics(spark, sf_dir):
    return report.metrics_table(wide(spark, sf_dir))


def ratio_table(spark, sf_dir):
    return report.ratio_table(rated(spark, sf_dir))


def risk_table(spark, sf_dir):
    return report.risk_table(wide(spark, sf_dir), risks(spark, sf_dir))


def risk_assessment(spark, sf_dir):
    return report.risk_assessment(wide(spark, sf_dir), risks(spark, sf_dir))


def comparison_table(spark, sf_dir):
    return report.comparison_table(wide(spark, sf_dir), peers(spark, sf_dir))


def research_table(spark, sf_dir):
    return report.research_table(wide(spark, sf_dir), research(spark, sf_dir))


def performance_commentary(spark, sf_dir):
    return report.commentary(wide(spark, sf_dir))


def ratio_commentary(spark, sf_dir):
    return report.ratio_commentary(rated(spark, sf_dir))


def swot(spark, sf_dir):
    return report.swot(counted(spark, sf_dir))


def key_takeaways(spark, sf_dir):
    return report.key_takeaways(counted(spark, sf_dir))


def executive_summary(spark, sf_dir):
    return report.executive_summary(wide(spark, sf_dir))


def company_overview(spark, sf_dir):
    return report.company_overview(wide(spark, sf_dir))


def chart_series(spark, sf_dir):
    c = report.chart_series(*inputs(spark, sf_dir)[:4])
    return c.withColumn("value", F.col("value").cast("double"))


def report_sections(spark, sf_dir):
    s = report.sections(*inputs(spark, sf_dir), DATE)
    return s.select("company", "fy", "section_no", "section", F.md5("body").alias("body_md5"))


def report_assembly(spark, sf_dir):
    a = report.assembly(*inputs(spark, sf_dir))
    first = lambda c, f: F.coalesce(F.get(c, F.lit(0))[f], F.lit(""))
    return a.select(
        "company", "fy", F.col("extraction.revenue").cast("double").alias("revenue"), F.size("extraction.financial_ratios").alias("n_ratios"), F.size("risks").alias("n_risks"), F.size("peers").alias("n_peers"),
        F.size("research").alias("n_research"), first("risks", "category").alias("first_risk"), first("peers", "peer").alias("first_peer"), first("research", "question").alias("first_question"),
    )


def labelled_metrics(spark, sf_dir):
    """The labels of reports of figures, written out with a line for each figure that there is."""
    line = lambda label, c: F.concat(F.lit(f"{label}: "), F.col(c).cast("string"))
    lines = [line("Company", "company"), line("Revenue", "revenue"), line("Net Income", "net_profit"), line("Total Assets", "assets"), line("Total Liabilities", "liabilities"), line("Cash Flow from Operations", "cash_flow"), line("Gross Margin", "gross_margin"), line("Earnings Per Share (EPS)", "eps")]
    texts = wide(spark, sf_dir).select("company", "fy", F.concat_ws("\n", *lines).alias("text"))
    return extract.labelled_metrics(texts)


QUERIES = {
    f.__name__: f
    for f in (
        report_metrics, ratio_table, risk_table, risk_assessment, comparison_table, research_table, performance_commentary, ratio_commentary, swot, key_takeaways,
        executive_summary, company_overview, chart_series, report_sections, report_assembly, labelled_metrics,
    )
}

# The twins spell the rules and sentences out once more, so that they check those of the operators.
_W = rf"""fin as ({FIGURES_ORACLE}),
wide as (select *, cast(revenue as varchar) as t1, cast(net_profit as varchar) as t2, cast(eps as varchar) as t3, cast(operating_margin as varchar) as t4, cast(gross_margin as varchar) as t5,
  cast(ebitda as varchar) as t6, cast(assets as varchar) as t7, cast(liabilities as varchar) as t8, cast(cash_flow as varchar) as t9 from fin),
names as (select unnest(['Revenue', 'Net Profit', 'EPS', 'Operating Margin', 'Gross Margin', 'EBITDA', 'Assets', 'Liabilities', 'Cash Flow']) as metric, unnest(range(1, 10)) as no),
cell as (select company, fy, no, metric, [t1, t2, t3, t4, t5, t6, t7, t8, t9][no] as v from wide, names),
filing as ({ORACLE}),
d as (select filing_id as doc_id, company, cast(filing_id % 10000 as int) as fy, text, lower(text) as low from filing),
risks as (
  select company, fy, 'performance' as category, 'High' as severity, 'The retrieved evidence mentions a decline in financial performance.' as description from d where regexp_matches(low, 'declin|drop|fell|down|reduced')
  union all select company, fy, 'capital_structure', 'Medium', 'The evidence references borrowings, debt, or higher liabilities.' from d where regexp_matches(low, 'borrow|debt|liability|leverag')
  union all select company, fy, 'liquidity', 'Medium', 'The evidence mentions cash flow or liquidity concerns.' from d where regexp_matches(low, 'cash flow|liquidity|working capital')),
nation as (select wide.*, s_nationkey as nation from wide join supplier on suppkey = s_suppkey),
best as (select * from nation qualify row_number() over (partition by nation, fy order by revenue desc, company) <= {PEERS}),
peers as (select a.company, a.fy, b.company as peer, b.revenue, b.net_profit, b.operating_margin, b.liabilities as debt, b.cash_flow from nation a join best b using (nation, fy) where a.company <> b.company),
vals as (select doc_id, company, fy as own, unnest(regexp_extract_all(text, '[A-Z][A-Za-z\-]*(?: [A-Z][A-Za-z\-]*)*: \$?[0-9][0-9,]*(?:\.[0-9]+)? ?(?:thousand|million|billion|%)? ?\(FY[0-9]{{4}}\)')) as x from d),
research as (
  select company, own as fy, 'What was ' || split_part(x, ':', 1) || ' before?' as question, split_part(x, ':', 1) || ' of FY' || regexp_extract(x, 'FY([0-9]{{4}})', 1) || ' is reported.' as answer, doc_id || '.txt' as source
  from vals where cast(regexp_extract(x, 'FY([0-9]{{4}})', 1) as int) < own),
rat as (
  select company, fy, r.k as ratio, cast(r.v as decimal(20,2)) as v from (select company, fy, unnest([
    {{'k': 'ROE', 'v': floor(cast(net_profit as double) / nullif(cast(assets - liabilities as double), 0) * 100) / 100}}, {{'k': 'ROA', 'v': floor(cast(net_profit as double) / nullif(cast(assets as double), 0) * 100) / 100}},
    {{'k': 'Debt-to-Equity', 'v': floor(cast(liabilities as double) / nullif(cast(assets - liabilities as double), 0) * 100) / 100}}, {{'k': 'Profit Margin', 'v': floor(cast(net_profit as double) / nullif(cast(revenue as double), 0) * 100) / 100}},
    {{'k': 'Operating Margin', 'v': cast(operating_margin as double)}}]) as r from wide) where r.v is not null),
n as (select company, fy, (select count(*) from risks x where x.company = w.company and x.fy = w.fy) as n_risks, (select count(*) from peers x where x.company = w.company and x.fy = w.fy) as n_peers,
  (select count(*) from research x where x.company = w.company and x.fy = w.fy) as n_research from wide w),
perf as (select company, fy, no, metric, coalesce(metric || ': Reported value is ' || v || '. This metric should be analysed alongside historical performance and industry benchmarks to assess the company''s financial health.',
  metric || ': Information was not available in the source documents.') as sentence from cell),
known as (select unnest(['ROE', 'ROA', 'Current Ratio', 'Debt-to-Equity', 'Profit Margin', 'Operating Margin']) as ratio, unnest(range(1, 7)) as no, unnest(['Return on Equity measures how efficiently shareholder capital is used.',
  'Return on Assets measures how efficiently assets generate profit.', 'Measures the company''s ability to meet short-term obligations.', 'Indicates the level of financial leverage.',
  'Shows how much profit is earned from each unit of revenue.', 'Measures operating efficiency before interest and taxes.']) as meaning),
rcom as (select w.company, w.fy, no, known.ratio, case when v is null then known.ratio || ': Information not available.' else known.ratio || ': ' || v || chr(10) || 'Interpretation: ' || meaning end as sentence
  from wide w cross join known left join rat on rat.company = w.company and rat.fy = w.fy and rat.ratio = known.ratio),
rtab as (select w.company, w.fy, coalesce(ratio, 'No Ratio Available') as ratio, coalesce(cast(v as varchar), 'N/A') as value from wide w left join rat using (company, fy)),
risk1 as (select w.company, w.fy, coalesce(category, 'General') as category, coalesce(severity, 'Low') as severity, coalesce(description, 'No major financial risks detected.') as description from wide w left join risks using (company, fy)),
risk2 as (select w.company, w.fy, coalesce(category, 'General') as category, coalesce(severity, 'Low') as severity, coalesce(description, 'No major financial risks were identified.') as description from wide w left join risks using (company, fy)),
comp as (select w.company, w.fy, coalesce(peer, 'No Comparison Data') as peer, case when peer is null then '-' else cast(p.revenue as varchar) end as revenue, case when peer is null then '-' else cast(p.net_profit as varchar) end as net_profit,
  case when peer is null then '-' else cast(p.operating_margin as varchar) end as operating_margin, case when peer is null then '-' else cast(p.debt as varchar) end as debt, case when peer is null then '-' else cast(p.cash_flow as varchar) end as cash_flow
  from wide w left join peers p using (company, fy)),
rese as (select w.company, w.fy, coalesce(question, 'No Research') as question, coalesce(answer, '-') as answer, coalesce(source, '-') as source from wide w left join research using (company, fy)),
sw as (
  select company, fy, 'Strengths' as quadrant, 'Company is generating profits.' as statement from wide where net_profit <> 0
  union all select company, fy, 'Strengths', 'Positive cash flow supports operations.' from wide where cash_flow <> 0
  union all select company, fy, 'Weaknesses', 'Financial risks have been identified.' from n where n_risks > 0
  union all select company, fy, 'Opportunities', 'Benchmarking against peers may identify growth opportunities.' from n where n_peers > 0
  union all select company, fy, 'Threats', 'Changing market conditions may impact future financial performance.' from wide),
keyp as (select company, fy, list_filter([case when revenue is not null then 'Revenue information successfully extracted.' end, case when net_profit is not null then 'Profitability metrics are available.' end,
  case when n_risks > 0 then n_risks || ' financial risks detected.' else 'No significant financial risks detected.' end, case when n_peers > 0 then 'Company comparison completed.' end,
  case when n_research > 0 then 'Research findings include cited evidence.' end], lambda x: x is not null) as l from wide join n using (company, fy)),
keyt as (select company, fy, k as no, coalesce(l[k], 'Additional financial analysis recommended.') as takeaway from keyp, unnest(range(1, 11)) t(k)),
execu as (select company, fy, company || ' has been analysed using the report system. The report combines financial extraction, risk detection, company comparison, and research findings to provide an overall assessment of the organisation.'
  || coalesce(chr(10) || chr(10) || 'The company reported revenue of ' || format('{{:,.2f}}', cast(revenue as double)) || ', indicating the scale of its operations.', '')
  || coalesce(' Net profit of ' || format('{{:,.2f}}', cast(net_profit as double)) || ' reflects overall profitability.', '')
  || coalesce(' Operating margin of ' || t4 || '% provides insight into operational efficiency.', '')
  || chr(10) || chr(10) || 'Overall, the financial information suggests that further evaluation of profitability, liquidity, financial risks and competitive positioning is required before drawing investment conclusions.' as summary from wide),
over_ as (select company, fy, 'Company Name: ' || company || chr(10) || chr(10) || 'Industry: ' || coalesce(industry, 'Information not available') || chr(10) || chr(10) || 'Business Model:' || chr(10) || 'Information not available'
  || chr(10) || chr(10) || 'Market Position:' || chr(10) || 'Information not available' as overview from wide),
charts as (
  select company, fy, ['revenue_profit', 'revenue_profit', 'assets_liabilities', 'assets_liabilities', 'cash_flow'][k] as chart, ['Revenue', 'Net Profit', 'Assets', 'Liabilities', 'Cash Flow'][k] as label,
    cast(coalesce([revenue, net_profit, assets, liabilities, cash_flow][k], 0) as decimal(20,2)) as value from wide, unnest(range(1, 6)) t(k)
  union all select company, fy, 'ratios', ratio, v from rat
  union all select w.company, w.fy, 'risk_distribution', level, cast(count(severity) as decimal(20,2)) from wide w cross join (select unnest(['Low', 'Medium', 'High']) as level) left join risks r on r.company = w.company and r.fy = w.fy and r.severity = level group by all
  union all select company, fy, 'company_comparison', peer, cast(coalesce(revenue, 0) as decimal(20,2)) from peers)"""

ORACLES = {
    "report_metrics": f"with {_W} select company, fy, metric, coalesce(v, 'N/A') as value from cell",
    "ratio_table": f"with {_W} select * from rtab",
    "risk_table": f"with {_W} select * from risk1",
    "risk_assessment": f"with {_W} select * from risk2",
    "comparison_table": f"with {_W} select * from comp",
    "research_table": f"with {_W} select * from rese",
    "performance_commentary": f"with {_W} select * from perf",
    "ratio_commentary": f"with {_W} select * from rcom",
    "swot": f"with {_W} select * from sw",
    "key_takeaways": f"with {_W} select * from keyt",
    "executive_summary": f"with {_W} select * from execu",
    "company_overview": f"with {_W} select * from over_",
    "chart_series": f"with {_W} select company, fy, chart, label, cast(value as double) as value from charts",
    "labelled_metrics": f"""with {_W} select company, fy, ['Company', 'Revenue', 'Net Income', 'Total Assets', 'Total Liabilities', 'Cash Flow', 'EPS'][k] as metric, coalesce([company, t1, t2, t7, t8, t9, t3][k], 'Not Found') as value from wide, unnest(range(1, 8)) t(k)""",
    "report_assembly": f"""with {_W} select company, fy, cast(revenue as double) as revenue, (select count(*) from rat r where r.company = w.company and r.fy = w.fy) as n_ratios, n_risks, n_peers, n_research,
  coalesce((select min(category) from risks r where r.company = w.company and r.fy = w.fy), '') as first_risk, coalesce((select min(peer) from peers r where r.company = w.company and r.fy = w.fy), '') as first_peer,
  coalesce((select min(question) from research r where r.company = w.company and r.fy = w.fy), '') as first_question from wide w join n using (company, fy)""",
    "report_sections": rf"""with {_W},
titles as (select ['Cover', 'Contents', 'Executive Summary', 'Company Overview', 'Financial Performance', 'Financial Metrics', 'Ratio Analysis', 'Ratio Table', 'Charts', 'Risk Assessment', 'Risk Table', 'SWOT Analysis',
  'Company Comparison', 'Research Findings', 'Investment Outlook', 'Key Takeaways', 'Conclusion', 'Appendix'] as t),
body as (
  select company, fy, 1 as i, company || chr(10) || '{DATE}' as b from wide
  union all select company, fy, 2, array_to_string(list_transform(range(1, 17), lambda k: k || '. ' || t[k + 2]), chr(10)) from wide, titles
  union all select company, fy, 3, summary from execu union all select company, fy, 4, overview from over_
  union all select company, fy, 5, string_agg(sentence, chr(10) order by no) from perf group by company, fy
  union all select company, fy, 6, string_agg(metric || ' | ' || coalesce(v, 'N/A'), chr(10) order by no) from cell group by company, fy
  union all select company, fy, 7, string_agg(sentence, chr(10) order by no) from rcom group by company, fy
  union all select company, fy, 8, string_agg(ratio || ' | ' || value, chr(10) order by ratio) from rtab group by company, fy
  union all select company, fy, 9, string_agg(chart || ' | ' || label || ' | ' || value, chr(10) order by chart, label) from charts group by company, fy
  union all select company, fy, 10, string_agg(category || ' | ' || severity || ' | ' || description, chr(10) order by category, severity, description) from risk2 group by company, fy
  union all select company, fy, 11, string_agg(category || ' | ' || severity || ' | ' || description, chr(10) order by category, severity, description) from risk1 group by company, fy
  union all select company, fy, 12, string_agg(quadrant || ' | ' || statement, chr(10) order by quadrant, statement) from sw group by company, fy
  union all select company, fy, 13, string_agg(concat_ws(' | ', peer, revenue, net_profit, operating_margin, debt, cash_flow), chr(10) order by peer) from comp group by company, fy
  union all select company, fy, 14, string_agg(question || ' | ' || answer || ' | ' || source, chr(10) order by question, source, answer) from rese group by company, fy
  union all select company, fy, 15, 'This report provides an objective assessment of the company''s financial position based on the available financial documents. The findings should be considered alongside broader market, industry, and economic factors. This report does not constitute investment advice.' from wide
  union all select company, fy, 16, string_agg(takeaway, chr(10) order by no) from keyt group by company, fy
  union all select company, fy, 17, 'The financial information available for ' || company || ' has been successfully analysed using the report system. This report combines structured financial data, detected risks, company benchmarking and research findings into a single analyst-style document.'
    || chr(10) || chr(10) || 'The results should be interpreted alongside industry trends, macroeconomic conditions and future company disclosures. This report is intended for educational and analytical purposes and does not constitute investment advice.' from wide
  union all select company, fy, 18, 'Figures of FY' || fy || '.' from wide)
select company, fy, i as section_no, t[i] as section, md5(b) as body_md5 from body, titles""",
}
