"""Filings made of the line items: one text for each supplier and year of shipping.

The same SQL text runs on Spark and, for the oracles, on DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from argosy.session import table

SQL = """
with li as (
  select l_suppkey as suppkey, year(l_shipdate) as fy,
         sum(cast(l_extendedprice as decimal(18,2))) as revenue,
         sum(case when l_returnflag = 'R' then cast(l_extendedprice as decimal(18,2)) else cast(0 as decimal(18,2)) end) as debt,
         sum(case when l_linestatus = 'F' then cast(l_extendedprice as decimal(18,2)) else cast(0 as decimal(18,2)) end) as assets,
         count(*) as n_lines
  from {lineitem} group by l_suppkey, year(l_shipdate)),
m as (
  select suppkey, fy, revenue, debt, assets, n_lines,
         cast(floor(cast(debt as double) * 100 / cast(revenue as double)) as int) as debt_pct,
         lag(revenue) over (partition by suppkey order by fy) as prev_revenue,
         lag(debt) over (partition by suppkey order by fy) as prev_debt
  from li)
select cast(suppkey as bigint) * 10000 + fy as filing_id,
       'Supplier ' || cast(suppkey as varchar(20)) || ' Holdings Ltd' as company,
       'FY' || cast(fy as varchar(10)) as period,
       'Supplier ' || cast(suppkey as varchar(20)) || ' Holdings Ltd' || chr(10) ||
       'Annual Report ' || cast(fy as varchar(10)) || chr(10) || chr(10) ||
       'Income Statement Highlights' || chr(10) || chr(10) ||
       'Total Revenue: $' || cast(revenue as varchar(30)) || ' (FY' || cast(fy as varchar(10)) || ')' ||
       case when prev_revenue is null then '' else ', compared to Total Revenue: $' || cast(prev_revenue as varchar(30)) || ' (FY' || cast(fy - 1 as varchar(10)) || ')' end || chr(10) ||
       'Order Lines: ' || cast(n_lines as varchar(20)) || '.0 million (FY' || cast(fy as varchar(10)) || ')' || chr(10) || chr(10) ||
       'Balance Sheet Highlights' || chr(10) || chr(10) ||
       'Total Assets: $' || cast(assets as varchar(30)) || ' (FY' || cast(fy as varchar(10)) || ')' || chr(10) ||
       'Total Debt: $' || cast(debt as varchar(30)) || ' (FY' || cast(fy as varchar(10)) || ')' ||
       case when prev_debt is null then '' else ', compared to Total Debt: $' || cast(prev_debt as varchar(30)) || ' (FY' || cast(fy - 1 as varchar(10)) || ')' end || chr(10) ||
       'Debt-to-Revenue Ratio: ' || cast(debt_pct as varchar(10)) || ' % (FY' || cast(fy as varchar(10)) || ')' || chr(10) || chr(10) ||
       case when prev_debt is not null and debt > prev_debt then 'Risk Factors' || chr(10) || chr(10) || 'Borrowings rose. Liquidity and working capital need review.'
            when prev_revenue is not null and revenue < prev_revenue then 'Risk Factors' || chr(10) || chr(10) || 'Revenue fell and margins were reduced.'
            else 'Auditor''s Report' || chr(10) || chr(10) || 'The auditors issued an unqualified opinion.' end as text
from m
"""

#: Nine figures for each supplier and year of shipping, whole numbers as decimals, some of them null.
FIGURES = """
with li as (
  select l_suppkey as suppkey, year(l_shipdate) as fy, count(*) as n,
         sum(cast(l_extendedprice as decimal(12,2))) as sales,
         sum(cast(l_extendedprice as decimal(12,2)) * (cast(0.06 as decimal(4,2)) - cast(l_discount as decimal(4,2)))) as profit,
         sum(cast(l_extendedprice as decimal(12,2)) * cast(l_tax as decimal(4,2))) as earned,
         sum(case when l_returnflag = 'R' then cast(l_extendedprice as decimal(12,2)) else cast(0 as decimal(12,2)) end) as owed,
         sum(case when l_linestatus = 'F' then cast(l_extendedprice as decimal(12,2)) else cast(0 as decimal(12,2)) end) as held,
         sum(case when l_linestatus = 'O' then cast(l_extendedprice as decimal(12,2)) else cast(0 as decimal(12,2)) end) as paid
  from {lineitem} group by l_suppkey, year(l_shipdate))
select cast(suppkey as bigint) as suppkey, 'Supplier ' || cast(suppkey as varchar(20)) || ' Holdings Ltd' as company, cast(fy as int) as fy,
       cast(floor(sales) as decimal(20,2)) as revenue, cast(floor(profit) as decimal(20,2)) as net_profit,
       cast(floor(cast(profit as double) / n) as decimal(20,2)) as eps,
       cast(floor(cast(profit as double) * 100 / cast(sales as double)) as decimal(20,2)) as operating_margin,
       case when mod(suppkey, 3) > 0 then cast(floor(cast(earned as double) * 100 / cast(sales as double)) as decimal(20,2)) end as gross_margin,
       cast(floor(earned) as decimal(20,2)) as ebitda, cast(floor(held) as decimal(20,2)) as assets, cast(floor(owed) as decimal(20,2)) as liabilities,
       case when paid > 0 then cast(floor(paid) as decimal(20,2)) end as cash_flow,
       case when mod(suppkey, 2) = 0 then 'Trade' end as industry
from li
"""


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(suppkey, company, fy, the nine figures, industry)."""
    return spark.sql(FIGURES, lineitem=table(spark, sf_dir, "lineitem"))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(filing_id, company, period, text)."""
    return spark.sql(SQL, lineitem=table(spark, sf_dir, "lineitem"))


#: For oracles: CTE bodies.
FIGURES_ORACLE = FIGURES.replace("{lineitem}", "lineitem")
ORACLE = SQL.replace("{lineitem}", "lineitem")
