"""Registered queries that cut, profile and describe texts, and their SQL twins for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argosy.functions import tags
from argosy.functions import text as tx
from argosy.operators import chunk, company, layout, metadata, redflag
from argosy.plans.filings import ORACLE, filings
from argosy.session import table
from argosy.sources import files

AS_OF_YEAR = 2026


def documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", *more)


def filing_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings(spark, sf_dir).select(F.col("filing_id").alias("doc_id"), "company", "text")


def filing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings with a page for each two of their blocks."""
    parts = filing_docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("p", "t"))
    page = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "t"))), lambda x: x["t"]), "\n\n")
    return parts.groupBy("doc_id", (F.floor(F.col("p") / 2) + 1).cast("int").alias("page_number")).agg(page.alias("text"))


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a page for each line that ends with a full stop."""
    return documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", r"(?<=\.)\n")).alias("p", "text")).select("doc_id", (F.col("p") + 1).alias("page_number"), "text")


def paragraph_pack(spark, sf_dir):
    d = documents(spark, sf_dir).withColumn("text", F.regexp_replace("text", "\n", "\n\n"))
    return chunk.paragraph_chunks(d).select("doc_id", "chunk_index", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


def sentence_pack(spark, sf_dir):
    return chunk.sentence_chunks(documents(spark, sf_dir), 450, 100).select("doc_id", "chunk_index", F.size(tx.words(F.col("text"))).alias("words"), F.md5("text").alias("text_md5"))


def semantic_pack(spark, sf_dir):
    d = documents(spark, sf_dir).withColumn("text", F.regexp_replace("text", "\n", "\n\n"))
    return chunk.semantic_chunks(d, 120, 20).select("doc_id", "chunk_index", F.size(tx.words(F.col("text"))).alias("words"), F.md5("text").alias("text_md5"))


def wordsafe_windows(spark, sf_dir):
    c = chunk.wordsafe_chunks(documents(spark, sf_dir))
    return c.select("doc_id", "chunk_index", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


def page_margins(spark, sf_dir):
    return chunk.strip_repeated_margins(document_pages(spark, sf_dir)).select("doc_id", "page_number", F.md5("text").alias("text_md5"))


def page_records(spark, sf_dir):
    return files.page_records(document_pages(spark, sf_dir)).select("doc_id", "page_number", "content_length", F.md5("text").alias("text_md5"))


def evidence_texts(spark, sf_dir):
    return metadata.evidence_text(document_pages(spark, sf_dir)).select("doc_id", F.length("evidence").alias("chars"), F.md5("evidence").alias("evidence_md5"))


def repeated_headers(spark, sf_dir):
    return company.repeated_headers(document_pages(spark, sf_dir))


def frequency_candidates(spark, sf_dir):
    return company.frequency_candidates(documents(spark, sf_dir).select("doc_id", F.left("text", F.lit(company.COVER_CHARS)).alias("cover")))


def section_carry(spark, sf_dir):
    d = layout.section_carry(layout.blocks(filing_pages(spark, sf_dir)))
    return d.select("doc_id", "page_number", "pos", "kind", "section_title", "section_type")


def block_chunks(spark, sf_dir):
    return layout.block_chunks(filing_pages(spark, sf_dir)).select("doc_id", "page_number", "chunk_index", "section_title", F.md5("text").alias("text_md5"))


def tabled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of filings; a third of them with tables in place of labelled lines, a third with notes and lists."""
    bars = F.regexp_replace("text", ": ", " | ")
    noted = F.concat(F.lit("Note 1: figures are rounded.\n\n"), "text", F.lit("\n\n- one item\n- and another"))
    return filing_pages(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 3 == 0, bars).when(F.col("doc_id") % 3 == 1, noted).otherwise(F.col("text")))


def layout_chunks(spark, sf_dir):
    c = layout.layout_chunks(tabled_pages(spark, sf_dir), 14, 4)
    return c.select("doc_id", "chunk_index", F.array_join("block_types", ",").alias("block_types"), F.array_join(F.transform("page_numbers", lambda x: x.cast("string")), ",").alias("page_numbers"), "section_title", F.md5("text").alias("text_md5"))


def table_rows(spark, sf_dir):
    """The rows of the blocks that are tables once their colons are bars."""
    b = layout.blocks(filing_docs(spark, sf_dir).withColumn("text", F.regexp_replace("text", ": ", " | ")))
    return b.filter("kind = 'table'").select("doc_id", "pos", F.array_join(layout.table_rows(F.col("text")), "\n").alias("rows"))


def table_profiles(spark, sf_dir):
    d = filing_docs(spark, sf_dir)
    return d.select("doc_id", F.inline(F.array(tags.table_profile(F.col("text")))))


def document_metadata(spark, sf_dir):
    d = filing_docs(spark, sf_dir)
    cols = metadata.document_columns(F.col("text"), AS_OF_YEAR)
    return d.select("doc_id", *(v.alias(k) for k, v in cols.items()))


def text_years(spark, sf_dir):
    """Year, period and currency of texts that name several of each."""
    k = F.col("doc_id") % 5
    said = F.element_at(F.array(*map(F.lit, [" fiscal year ended June 30, 2021", " Q3 FY 2022 in EUR", " Annual Report 2023. Outlook to 2025", " FY24 and GBP", " grew from 1999 to 2031"])), (k + 1).cast("int"))
    d = documents(spark, sf_dir).withColumn("text", F.concat(F.coalesce("text", F.lit("")), said, F.lit(" paid $5 or INR 7, year ended May 1, 2020")))
    cols = metadata.document_columns(F.col("text"), AS_OF_YEAR)
    return d.select("doc_id", *(cols[c].alias(c) for c in ("financial_year", "report_period", "currency", "fiscal_year_start", "fiscal_year_end")))


NAMES = ["acme_annual_report_2023.pdf", "in/q3_fy22_results.txt", "proxy_statement.pdf", "a.b/notes_to_1999.v2.txt", "acme_esg_report_2019"]


def file_name_metadata(spark, sf_dir):
    """What a file's name adds to its text: title, type, year and period; the currency is the text's alone."""
    path = F.get(F.array(*map(F.lit, NAMES)), (F.col("doc_id") % 5).cast("int"))
    cols = metadata.document_columns(F.coalesce("text", F.lit("")), AS_OF_YEAR, F.concat(path, F.when(F.col("doc_id") % 7 == 0, "_usd").otherwise("")))
    year = F.coalesce(cols["financial_year"].cast("string"), F.lit(""))
    return documents(spark, sf_dir).select("doc_id", year.alias("financial_year"), *(cols[c].alias(c) for c in ("document_title", "report_type", "report_period", "currency")))


def chunk_entities(spark, sf_dir):
    """Names, amounts and terms of filings, with a sentence that has some more of each."""
    more = F.concat(F.lit("\nPartners include Alpha Steel, Beta Mills; CEO Jane Doe leads. The ticker: ABC. Sold in Germany and India. See the chart and footnote 3. Unaudited guidance, litigation. Growth of 5% in "), F.col("company"))
    c = F.concat(F.col("text"), more)
    return filing_docs(spark, sf_dir).select(
        "doc_id",
        *(metadata.named_values(c, v).alias(k) for k, v in metadata.NAMED.items()),
        metadata.people(c).alias("people"),
        tx.csv_set(F.regexp_extract_all(c, F.lit(metadata.COUNTRIES), 0)).alias("countries"),
        F.regexp_extract(c, metadata.TICKER, 1).alias("company_ticker"),
        F.size(metadata.financial_values(c)).alias("n_values"),
        tags.keyword_matches(c, metadata.INVESTMENT).alias("investment_keywords"),
        tags.keyword_matches(c, metadata.RISKS).alias("risks"),
        tags.keyword_matches(c, metadata.AUDIT).alias("is_audited"),
        c.rlike(metadata.CHART).alias("contains_chart"),
        c.rlike(metadata.FOOTNOTE).alias("contains_footnotes"),
        tags.infer_section(F.col("text")).alias("passage_section"),
    )


def metadata_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layout chunks of filings with all metadata columns."""
    d = filings(spark, sf_dir).select(F.col("filing_id").alias("doc_id"), "company", "text", F.concat("filing_id", F.lit(".txt")).alias("source"), F.sha2("text", 256).alias("doc_hash"), F.concat(F.lit("s"), F.col("filing_id") % 10).alias("analysis_id"))
    c = layout.layout_chunks(filing_pages(spark, sf_dir), 40, 10)
    c = c.withColumn("chunk_id", F.concat_ws("-", "doc_id", "chunk_index")).join(c.groupBy("doc_id").agg(F.count("*").cast("int").alias("total_chunks")), "doc_id")
    return metadata.chunk_metadata(c, d, AS_OF_YEAR)


def chunk_metadata(spark, sf_dir):
    return metadata_chunks(spark, sf_dir).drop("text", "ingestion_timestamp")


def chunk_id_hashes(spark, sf_dir):
    d = documents(spark, sf_dir, "source")
    return chunk.char_chunks(d).select("doc_id", "chunk_index", chunk.chunk_id_hash(F.concat(F.lit("/"), F.col("doc_id").cast("string")), F.coalesce("source", F.lit("")), F.col("chunk_index")).alias("chunk_hash"))


def passage_risks(spark, sf_dir):
    """A row for each sentence and category, with the page that it stands on."""
    rows = redflag.passage_risks(filing_pages(spark, sf_dir))
    return rows.select("doc_id", "page_number", "category", F.md5("evidence").alias("evidence_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        paragraph_pack, sentence_pack, semantic_pack, wordsafe_windows, page_margins, page_records, evidence_texts, repeated_headers, frequency_candidates, section_carry, block_chunks,
        layout_chunks, table_rows, table_profiles, document_metadata, file_name_metadata, text_years, chunk_entities, chunk_metadata, chunk_id_hashes, passage_risks,
    )
}

# The twins spell the rules out once more, so that they check those of the operators.
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_D = f"filing as ({ORACLE}), d as (select filing_id as doc_id, company, text from filing)"
_PAGES = r"""pages as (select doc_id, i as page_number, string_split(regexp_replace(text, '\.\n', '.' || chr(1), 'g'), chr(1))[i] as text
  from documents, unnest(range(1, len(string_split(regexp_replace(text, '\.\n', '.' || chr(1), 'g'), chr(1))) + 1)) t(i))"""
_CLEAN = _STRIP.format(r"regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")


def _pack(parts: str, measure: str, size: int, carry: int) -> str:
    """CTEs that pack the parts (doc_id, i, x) greedily: r (doc_id, i, used, chunk)."""
    return f"""p as (select doc_id, row_number() over (partition by doc_id order by i) as i, x, {measure} as n from ({parts})),
r as (
  select doc_id, i, n as used, 0 as chunk from p where i = 1
  union all
  select p.doc_id, p.i, case when r.used + p.n > {size} then least({carry}, r.used) + p.n else r.used + p.n end, r.chunk + case when r.used + p.n > {size} then 1 else 0 end
  from r join p on p.doc_id = r.doc_id and p.i = r.i + 1)"""


def _carried(joiner: str, carry: int) -> str:
    """The chunks of _pack with words carried: a chunk's text, behind the last words of all parts before it."""
    return f""", c as (select doc_id, chunk, min(i) as i, max(used) as words, string_agg(x, {joiner} order by i) as t from r join p using (doc_id, i) group by 1, 2),
d as (select doc_id, flatten(list(regexp_extract_all(x, '\\S+') order by i)) as ws, list(len(regexp_extract_all(x, '\\S+')) order by i) as ns from p group by 1),
e as (select doc_id, chunk, words, t, cast(coalesce(list_sum(ns[:i - 1]), 0) as bigint) as k, ws from c join d using (doc_id))
select doc_id, chunk as chunk_index, words, md5(case when chunk = 0 then t else array_to_string(ws[greatest(k - {carry}, 0) + 1:k], ' ') || {joiner} || t end) as text_md5 from e"""


_WORDS = r"len(regexp_extract_all(x, '\S+'))"
_LINES = r"select doc_id, i, " + _STRIP.format("l") + r" as x from (select doc_id, i, string_split(text, chr(10))[i] as l from documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) t(i)) where trim(l) <> ''"
_SENTENCES = r"""select doc_id, i, s[i] as x from (select doc_id, string_split(regexp_replace({}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) as s from documents), unnest(range(1, len(s) + 1)) t(i) where trim(s[i]) <> ''"""
_BLOCK_SENTENCES = r"""select doc_id, i * 100000 + k as i, s[k] as x from (select doc_id, i, case when len(regexp_extract_all(x, '\S+')) <= 120 then [x] else string_split(regexp_replace(x, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) end as s
  from (""" + _LINES + r""")), unnest(range(1, len(s) + 1)) t(k) where trim(s[k]) <> ''"""
_PAGE = rf"""pg as (select doc_id, cast((i - 1) // 2 + 1 as int) as page_number, string_agg(x, chr(10) || chr(10) order by i) as text
  from (select doc_id, i, string_split(text, chr(10) || chr(10))[i] as x from d, unnest(range(1, len(string_split(text, chr(10) || chr(10))) + 1)) t(i)) group by 1, 2)"""
_TABLED = r"""pt as (select doc_id, page_number, case doc_id % 3 when 0 then replace(text, ': ', ' | ') when 1 then 'Note 1: figures are rounded.' || chr(10) || chr(10) || text || chr(10) || chr(10) || '- one item' || chr(10) || '- and another' else text end as text from pg)"""
_BLOCK_KINDS = rf"""parts as (select doc_id, page_number, list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: {_STRIP.format("x")}), lambda x: x <> '') as b from pg),
b0 as (select doc_id, page_number, cast(i - 1 as int) as pos, b[i] as text, list_filter(list_transform(string_split(b[i], chr(10)), lambda x: {_STRIP.format("x")}), lambda x: x <> '') as l from parts, unnest(range(1, len(b) + 1)) t(i)),
blk as (
  select *, case when regexp_matches(l[1], '^(?:[-*•▪◦]|\(?\d{{1,3}}[.)])\s+') then 'list'
    when len(l) >= 2 and len(list_filter(l, lambda x: regexp_matches(x, '\||\t|\S\s{{2,}}\S.*\S\s{{2,}}\S'))) > 0 and len(list_filter(l, lambda x: regexp_matches(x, '\d'))) >= 2 then 'table'
    when regexp_matches(l[1], '(?i)^(note|notes|footnote|source)\s*\d*\s*[:.-]') then 'note'
    when len(l) = 1 and len(regexp_extract_all(l[1], '\S+')) <= 14 and not regexp_matches(l[1], '[.!?]$') then 'heading' else 'narrative' end as kind from b0),
head as (
  select *, case when kind <> 'heading' then null
    when regexp_matches(lower(text), 'risk factor') then row('Risk Factors', 'risk') when regexp_matches(lower(text), 'balance sheet') then row('Balance Sheets', 'financial_statement')
    when regexp_matches(lower(text), 'income statement') then row('Income Statement', 'financial_statement') when regexp_matches(lower(text), 'auditor''s report') then row('Auditor''s Report', 'financial_statement')
    else row(regexp_replace(text, '\s*[:–—-]\s*$', ''), 'other') end as h from blk),
sec as (select doc_id, page_number, pos, kind, text, coalesce(last_value(h ignore nulls) over w, row('', 'other')) as h from head window w as (partition by doc_id order by page_number, pos rows unbounded preceding))"""
_BLOCKS = f"{_PAGE}, {_BLOCK_KINDS}"


_LOW = r"lower(regexp_replace(text, '\s+', ' ', 'g'))"
_FORM = rf"""case when regexp_matches({_LOW}, '\b10-k\b') then '10-K' when regexp_matches({_LOW}, '\b10-q\b') then '10-Q' when regexp_matches({_LOW}, '\bproxy\b|definitive proxy statement|annual meeting of shareholders') then 'Proxy Statement'
  when regexp_matches({_LOW}, '\bintegrated report\b|\bintegrated annual report\b') then 'Integrated Report' when regexp_matches({_LOW}, '\b(sustainability|esg) report\b|\benvironmental,? social,? and governance report\b') then 'Sustainability Report'
  when regexp_matches({_LOW}, '\bquarterly report\b|\bquarter ended\b|\bq[1-4]\b') then 'Quarterly Report' when regexp_matches({_LOW}, '\bannual report\b|\bform 10-k\b') then 'Annual Report' else 'Other' end"""


def _named(c: str, labels: str) -> str:
    return rf"""array_to_string(list_sort(list_distinct(flatten(list_transform(regexp_extract_all({c}, '(?i)(?:{labels})\s*(?:include|are|:)?\s*([^.;\n]+)', 1), lambda x: regexp_extract_all(x, '\b[A-Z][A-Za-z0-9&.-]{{1,30}}(?:\s+[A-Z][A-Za-z0-9&.-]{{1,30}}){{0,3}}\b'))))), ',')"""


def _terms(c: str, terms: list[str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(rf"case when regexp_matches({c}, '(?i)(^|\W){t}(\W|$)') then '{t}' end" for t in sorted(terms)) + "], lambda x: x is not null), ',')"


_NUM = r"(?:\(?[-$€£₹]?\d[\d,]*(?:\.\d+)?%?\)?|\b(?:19|20)\d{2}\b)"
_MONEY_WORDS = r"(?i)\b(?:revenue|sales|income|earnings|assets|liabilities|equity|cash flow|cash and cash equivalents|debt|dividend|repurchase|shares|expense|gross margin|operating margin|net income|operating income|cost of revenue|accounts receivable|inventory)\b"
_YEAR = r"""case when regexp_matches(text, '(?i)\b(?:fiscal|financial)\s+year\s+(?:ended|ending)?\s*(?:\w+\s+\d{1,2},?\s+)?(?:19|20)\d{2}\b') then cast(regexp_extract(text, '(?i)\b(?:fiscal|financial)\s+year\s+(?:ended|ending)?\s*(?:\w+\s+\d{1,2},?\s+)?((?:19|20)\d{2})\b', 1) as int)
  when regexp_matches(text, '(?i)\byear\s+ended\s+(?:\w+\s+\d{1,2},?\s+)?(?:19|20)\d{2}\b') then cast(regexp_extract(text, '(?i)\byear\s+ended\s+(?:\w+\s+\d{1,2},?\s+)?((?:19|20)\d{2})\b', 1) as int)
  when regexp_matches(text, '(?i)\b(?:annual|integrated|sustainability|proxy|quarterly)\s+report\s+(?:19|20)\d{2}\b') then cast(regexp_extract(text, '(?i)\b(?:annual|integrated|sustainability|proxy|quarterly)\s+report\s+((?:19|20)\d{2})\b', 1) as int)
  when regexp_matches(text, '(?i)\b(?:FY|Q[1-4]\s*FY?)\s*(?:19|20)\d{2}\b') then cast(regexp_extract(text, '(?i)\b(?:FY|Q[1-4]\s*FY?)\s*((?:19|20)\d{2})\b', 1) as int)
  when regexp_matches(text, '(?i)\b(?:FY|Q[1-4]\s*FY?)\s*\d{2}\b') then 2000 + cast(regexp_extract(text, '(?i)\b(?:FY|Q[1-4]\s*FY?)\s*(\d{2})\b', 1) as int)
  else list_max(list_filter(list_transform(regexp_extract_all(text, '\b(?:19|20)\d{2}\b'), lambda x: cast(x as int)), lambda y: y between 1990 and 2027)) end"""
_PERIOD = r"""coalesce(nullif(upper(regexp_extract(text, '(?i)\b((?:Q[1-4])\s*(?:FY)?\s*(?:19|20)?\d{2})\b|\b(?:year ended|fiscal year ended)\s+([A-Za-z]+\s+\d{1,2},?\s+(?:19|20)\d{2})', 1)), ''),
  regexp_extract(text, '(?i)\b((?:Q[1-4])\s*(?:FY)?\s*(?:19|20)?\d{2})\b|\b(?:year ended|fiscal year ended)\s+([A-Za-z]+\s+\d{1,2},?\s+(?:19|20)\d{2})', 2), '')"""
_CURRENCY = r"""coalesce(nullif(regexp_extract(text, '(?i)\b(USD|INR|EUR|GBP|JPY|CAD|AUD)\b|([$€£₹])', 1), ''), case regexp_extract(text, '(?i)\b(USD|INR|EUR|GBP|JPY|CAD|AUD)\b|([$€£₹])', 2) when '$' then 'USD' when '€' then 'EUR' when '£' then 'GBP' when '₹' then 'INR' end, '')"""
_DATES = r"regexp_extract_all(text, '(?i)\b(?:beginning|starting|ended|ending)\s+([A-Za-z]+\s+\d{1,2},?\s+\d{4}|\d{4}[-/]\d{2}[-/]\d{2})', 1)"
_TITLE = r"(?im)^\s*(.{2,120}(?:annual|integrated|sustainability|esg|proxy|quarterly|earnings|10-k|10-q) (?:report|statement|filing).{0,80})\s*$"

ORACLES = {
    "paragraph_pack": f"with recursive {_pack(_LINES, 'length(x)', 1200, 0)}, c as (select doc_id, chunk as chunk_index, string_agg(x, chr(10) || chr(10) order by i) as t from r join p using (doc_id, i) group by 1, 2) select doc_id, chunk_index, length(t) as chars, md5(t) as text_md5 from c",
    "sentence_pack": f"with recursive {_pack(_SENTENCES.format('text'), _WORDS, 450, 100)}" + _carried("' '", 100),
    "semantic_pack": f"with recursive {_pack(_BLOCK_SENTENCES, _WORDS, 120, 20)}" + _carried("chr(10) || chr(10)", 20),
    "wordsafe_windows": """with recursive d as (select doc_id, text, length(text) as n from documents where text <> ''),
w as (
  select doc_id, 0 as s from d
  union all
  select doc_id, greatest(s + 1, least(case when e > 200 then e - 200 else e - 100 end, e - 1)) as s from (
    select doc_id, n, s, case when s + 1000 >= n then n when p = 0 or p > 1000 then s + 1000 else s + 1001 - p end as e from (
      select w.doc_id, n, s, strpos(reverse(substring(text, s + 1, 1001)), ' ') as p from w join d using (doc_id))) where e < n),
x as (select doc_id, s, {_STRIP_PIECE} as t from (select w.doc_id, s, text, n, strpos(reverse(substring(text, s + 1, 1001)), ' ') as p from w join d using (doc_id)))
select doc_id, row_number() over (partition by doc_id order by s) - 1 as chunk_index, length(t) as chars, md5(t) as text_md5 from x where t <> ''""".replace("{_STRIP_PIECE}", _STRIP.format("substring(text, s + 1, case when s + 1000 >= n then n - s when p = 0 or p > 1000 then 1000 else 1001 - p end)")),
    "page_margins": f"""with {_PAGES}, l as (select doc_id, page_number, string_split(regexp_replace(text, '\\n$', ''), chr(10)) as l from pages),
e as (select distinct doc_id, page_number, unnest(list_transform(list_concat(l[1:3], l[greatest(1, len(l) - 2):len(l)]), lambda x: {_STRIP.format('x')})) as line from l),
n as (select doc_id, count(*) as n from pages group by 1),
o as (select doc_id, list(line) as o from (select doc_id, line, any_value(n) as n, count(*) as k from e join n using (doc_id) where line <> '' group by 1, 2) where n >= 3 and k >= greatest(3, n // 2) group by 1)
select doc_id, page_number, md5(case when o is null then text else array_to_string(list_filter(l, lambda x: not list_contains(o, {_STRIP.format('x')})), chr(10)) end) as text_md5 from l join pages using (doc_id, page_number) left join o using (doc_id)""",
    "page_records": f"with {_PAGES}, c as (select doc_id, page_number, {_CLEAN} as t from pages) select doc_id, page_number, length(t) as content_length, md5(t) as text_md5 from c where t <> ''",
    "evidence_texts": f"with {_PAGES}, j as (select doc_id, string_agg(text, chr(10) || chr(10) order by page_number) filter (page_number <= 3) as a, string_agg(text, chr(10) || chr(10) order by page_number) as b from pages group by 1), e as (select doc_id, substring(a || chr(10) || chr(10) || b, 1, 16000) as t from j) select doc_id, length(t) as chars, md5(t) as evidence_md5 from e",
    "frequency_candidates": r"""with r as (select doc_id, unnest(regexp_extract_all(regexp_replace(substring(text, 1, 16000), '[À-ÖØ-öø-ÿ]', '_', 'g'), '\b[A-Z][A-Za-z&.-]{2,}(?:\s+[A-Z][A-Za-z&.-]{2,}){0,2}\b')) as line from documents),
n1 as (select doc_id, line, regexp_replace(regexp_replace(trim(regexp_replace(line, '\s+', ' ', 'g')), '(?i)^\s*(?:page\s*)?\d{1,4}\s+', ''), '(?i)^(?:the\s+)?(?:company|issuer|registrant|issuer name|registrant name|company name)\s*[:-]\s*', '') as name from r),
n2 as (select doc_id, line, regexp_replace(regexp_replace(name, '\s+(?:annual|quarterly|sustainability|esg|proxy|integrated|report|statement|letter|results|update|presentation|shareholder|notice|form)(?:\s+(?:report|statement|letter|results|update|presentation|shareholder|notice|form))*\s*(?:\b(?:19|20)\d{2}\b)?$', ''), '\s+\b(?:19|20)\d{2}\b$', '') as name from n1),
n as (select doc_id, line, trim(regexp_replace(name, '^[^A-Za-z0-9]+|[^A-Za-z0-9.]+$', '', 'g')) as name from n2),
c as (select doc_id, name from n where length(name) >= 3 and regexp_matches(name, '[A-Za-z]') and not regexp_matches(lower(name), '^(for|to) ') and len(string_split(name, ' ')) <= 8
  and not regexp_matches(regexp_replace(name, '(?i)\b(inc|ltd|corp|co)\.', '', 'g'), '[.!?]')
  and not regexp_matches(lower(name || ' ' || line), '\b(?:dear|shareholders?|colleagues|customers?|partners?|letter from|message from)\b')
  and not regexp_matches(name, '(?i)\b(?:annual|quarterly|sustainability|esg|proxy|integrated|report|statement|presentation|letter|notice|form|financial|management|risk|auditor|page|section|table|figure|note|notes|about|business overview|security overview|cybersecurity|income statement|balance sheets?|cash flows?|governance|liquidity|dividends?|initiative|program|project|campaign)\b')
  and not regexp_matches(name, '(?i)\b(?:github copilot|copilot|azure|windows|office|word|microsoft 365|artificial intelligence|generative ai|ai)\b')
  and not regexp_matches(lower(name || ' ' || line), '\b(?:continue|continues|drive|drives|delivered|generated|using|provides|platform|service|product|solution|technology)\b'))
select doc_id, name, count(*) as n from c group by 1, 2 having count(*) >= 3""",
    "section_carry": f"with {_D}, {_BLOCKS} select doc_id, page_number, pos, kind, h[1] as section_title, h[2] as section_type from sec",
    "block_chunks": f"""with {_D}, {_BLOCKS}, a as (select *, kind = 'table' and coalesce(lag(kind) over w, '') <> 'heading' as alone from sec window w as (partition by doc_id order by page_number, pos)),
g as (select *, sum(cast(kind = 'heading' or alone or coalesce(prev, true) as int)) over (partition by doc_id order by page_number, pos) - 1 as chunk_index from (select *, lag(alone) over (partition by doc_id order by page_number, pos) as prev from a))
select doc_id, min(page_number) as page_number, cast(chunk_index as bigint) as chunk_index, h[1] as section_title, md5(string_agg(text, chr(10) || chr(10) order by page_number, pos)) as text_md5 from g group by doc_id, chunk_index, h""",
    "layout_chunks": rf"""with recursive {_D}, {_PAGE}, {_TABLED}, {_BLOCK_KINDS.replace("from pg)", "from pt)")},
n1 as (select *, row_number() over (partition by doc_id, page_number order by pos) as n from head),
n2 as (select *, kind = 'heading' and (n - coalesce(max(case when kind <> 'heading' then n end) over (partition by doc_id, page_number order by pos rows unbounded preceding), 0)) % 2 = 1 as takes from n1),
n3 as (select *, coalesce(lag(takes) over w, false) as taken, lead(text) over w as nxt from n2 window w as (partition by doc_id, page_number order by pos)),
m as (select doc_id, page_number, pos, case when takes and nxt is not null then text || chr(10) || chr(10) || nxt else text end as text, case when takes and nxt is not null then 'narrative' else kind end as kind,
  coalesce(last_value(case when takes then h end ignore nulls) over (partition by doc_id order by page_number, pos rows unbounded preceding), row('', 'other')) as sec from n3 where not taken),
g as (select *, sum(cast(kind = 'table' as int)) over w as seg, coalesce(last_value(case when sec[1] <> '' and kind <> 'table' then sec end ignore nulls) over w, row('', 'other')) as label from m window w as (partition by doc_id order by page_number, pos rows unbounded preceding)),
-- sentences of long narratives, filled up to 14 words
sn as (select doc_id, page_number, pos, k, {_STRIP.format("s[k]")} as x from (select *, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) as s from g where kind = 'narrative' and len(regexp_extract_all(text, '\S+')) > 14), unnest(range(1, len(s) + 1)) t(k)),
sp as (select doc_id, page_number, pos, row_number() over (partition by doc_id, page_number, pos order by k) as k, x, len(regexp_extract_all(x, '\S+')) as n from sn where x <> ''),
sr as (select doc_id, page_number, pos, k, n as used, 0 as piece from sp where k = 1
  union all select sp.doc_id, sp.page_number, sp.pos, sp.k, case when sr.used + sp.n > 14 then sp.n else sr.used + sp.n end, sr.piece + cast(sr.used + sp.n > 14 as int) from sr join sp on sp.doc_id = sr.doc_id and sp.page_number = sr.page_number and sp.pos = sr.pos and sp.k = sr.k + 1),
pc as (select doc_id, seg, page_number, pos, 0 as piece, text, kind, label from g where kind <> 'table' and not (kind = 'narrative' and len(regexp_extract_all(text, '\S+')) > 14)
  union all select doc_id, any_value(seg), page_number, pos, piece, string_agg(x, ' ' order by k), 'narrative', any_value(label) from sr join sp using (doc_id, page_number, pos, k) join g using (doc_id, page_number, pos) group by doc_id, page_number, pos, piece),
q as (select *, row_number() over (partition by doc_id, seg order by page_number, pos, piece) as i, len(regexp_extract_all(text, '\S+')) as n, kind in ('list', 'heading', 'note') as alone from pc),
f as (
  select doc_id, seg, i, text as held, n as used, 0 as chunk, [page_number] as pages, [kind] as kinds, label from q where i = 1
  union all
  select doc_id, seg, i, case when not cut then held || chr(10) || chr(10) || text when alone then text else array_to_string(tail, ' ') || chr(10) || chr(10) || text end, n + case when cut then len(tail) else used end, chunk + cast(cut as int),
    case when not cut then list_append(pages, page_number) when alone then [page_number] else [pages[-1], page_number] end, case when not cut then list_append(kinds, kind) when alone then [kind] else ['narrative', kind] end, label
  from (select q.*, held, used, chunk, pages, kinds, q.alone or used + q.n > 14 as cut, list_reverse(list_reverse(regexp_extract_all(held, '\S+'))[1:4]) as tail from f join q on q.doc_id = f.doc_id and q.seg = f.seg and q.i = f.i + 1)),
-- rows of long tables, filled up to 14 words under the first
tl as (select doc_id, seg, page_number, sec, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '\s+$', '')), lambda x: x <> '') as l from g where kind = 'table'),
tw as (select *, len(regexp_extract_all(array_to_string(l, ' '), '\S+')) > 14 as long, len(regexp_extract_all(l[1], '\S+')) as h from tl),
tp as (select doc_id, seg, k - 1 as k, {_STRIP.format("l[k]")} as x, len(regexp_extract_all(l[k], '\S+')) as n, h from tw, unnest(range(2, len(l) + 1)) t(k) where long),
tr as (select doc_id, seg, k, h + n as used, 0 as piece from tp where k = 1
  union all select tp.doc_id, tp.seg, tp.k, case when tr.used + tp.n > 14 then tp.h + tp.n else tr.used + tp.n end, tr.piece + cast(tr.used + tp.n > 14 as int) from tr join tp on tp.doc_id = tr.doc_id and tp.seg = tr.seg and tp.k = tr.k + 1),
tb as (select doc_id, seg, page_number, sec, 0 as piece, array_to_string(l, chr(10)) as text from tw where not long or len(l) = 1
  union all select doc_id, seg, any_value(page_number), any_value(sec), piece, {_STRIP.format("any_value(l[1])")} || chr(10) || string_agg(x, chr(10) order by k) from tr join tp using (doc_id, seg, k) join tw using (doc_id, seg) group by doc_id, seg, piece),
al as (
  select doc_id, seg, 1 as t, chunk as piece, {_STRIP.format("arg_max(held, i)")} as text, arg_max(kinds, i) as kinds, arg_max(pages, i) as pages, arg_max(label, i)[1] as section_title from f group by doc_id, seg, chunk
  union all select doc_id, seg, 0, piece, {_STRIP.format("text")}, ['table'], [page_number], sec[1] from tb)
select doc_id, cast(row_number() over (partition by doc_id order by seg, t, piece) - 1 as int) as chunk_index, array_to_string(list_sort(list_distinct(kinds)), ',') as block_types,
  array_to_string(list_sort(list_distinct(pages)), ',') as page_numbers, section_title, md5(text) as text_md5 from al""",
    "table_rows": rf"""with {_D}, x as (select doc_id, list_filter(list_transform(string_split_regex(replace(text, ': ', ' | '), '\n\s*\n'), lambda x: {_STRIP.format('x')}), lambda x: x <> '') as b from d),
t as (select doc_id, cast(i - 1 as int) as pos, string_split(b[i], chr(10)) as l from x, unnest(range(1, len(b) + 1)) t(i))
select doc_id, pos, array_to_string(l, chr(10)) as rows from t where len(l) >= 2 and len(list_filter(l, lambda x: contains(x, '|'))) > 0 and len(list_filter(l, lambda x: regexp_matches(x, '\d'))) >= 2""",
    "table_profiles": rf"""with {_D}, l as (select doc_id, lower(text) as low, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> '') as l from d),
c as (select doc_id, low, len(l) as n, len(list_filter(l, lambda x: contains(x, chr(9)) or contains(x, '|') or len(string_split_regex(x, '\s{{2,}}')) >= 3)) as parted, len(list_filter(l, lambda x: len(regexp_extract_all(x, '{_NUM}')) >= 2)) as dense,
  len(list_filter(l, lambda x: regexp_matches(x, '{_NUM}'))) as numeric_, len(list_filter(l, lambda x: len(regexp_extract_all(x, '\b(?:19|20)\d{{2}}\b')) >= 2)) as dated, len(list_filter(l, lambda x: regexp_matches(x, '{_MONEY_WORDS}'))) as money,
  list_max(list_transform(l, lambda x: len(string_split_regex(x, '\s{{2,}}|\|')))) as wide, list_max(list_transform(l, lambda x: len(regexp_extract_all(x, '\S+')))) as words from l),
t as (select *, parted >= 2 or dense >= 3 or (numeric_ >= 4 and dated > 0) or (money >= 2 and numeric_ >= 3) as is_table from c),
m as (select *, is_table and (money >= 1 or (dated > 0 and dense > 0)) as is_financial_table from t)
select doc_id, is_table, is_financial_table, case when regexp_matches(low, 'balance sheets?|assets|liabilities') then 'Balance Sheet' when regexp_matches(low, 'cash flows?|operating activities|financing activities|investing activities') then 'Cash Flow'
  when regexp_matches(low, 'income|operations|earnings|revenue|sales') then 'Income Statement' when is_financial_table then 'Financial Table' when is_table then 'Table' else '' end as table_type,
  case when is_table then n else 0 end as rows, case when is_table then case when wide <= 1 and n >= 4 then greatest(wide, least(3, words // 2)) else wide end else 0 end as columns from m""",
    "document_metadata": rf"""with {_D}, t as (select *, substring({_STRIP.format("regexp_replace(regexp_extract(text, '" + _TITLE + r"', 1), '\s+', ' ', 'g')")}, 1, 200) as title from d)
select doc_id, title as document_title, title as report_title, case when regexp_matches(lower(text), '\bannual report\b') then 'Annual Report' else 'Other' end as report_type, {_YEAR} as financial_year, {_PERIOD} as report_period,
  '' as filing_date, coalesce({_DATES}[1], '') as fiscal_year_start, coalesce({_DATES}[-1], '') as fiscal_year_end, {_CURRENCY} as currency,
  case when len(regexp_extract_all(text, '(?i)\b(?:the|and|of|for|financial|report|corporate|company)\b')) >= 5 then 'English' else '' end as document_language, '' as industry from t""",
    "file_name_metadata": rf"""with n as (select doc_id, coalesce(text, '') as cover, ['acme annual report 2023', 'q3 fy22 results', 'proxy statement', 'notes to 1999.v2', 'acme esg report 2019'][doc_id % 5 + 1] || case when doc_id % 7 = 0 and doc_id % 5 = 4 then ' usd' else '' end as name from documents),
e as (select doc_id, cover || chr(10) || name as text from n), c as (select doc_id, {_CURRENCY} as currency from (select doc_id, cover as text from n))
select doc_id, trim(substring({_STRIP.format("regexp_replace(regexp_extract(text, '" + _TITLE + r"', 1), '\s+', ' ', 'g')")}, 1, 200)) as document_title, {_FORM} as report_type, coalesce(cast({_YEAR} as varchar), '') as financial_year, {_PERIOD} as report_period, currency from e join c using (doc_id)""",
    "text_years": rf"""with d as (select doc_id, coalesce(text, '') || [' fiscal year ended June 30, 2021', ' Q3 FY 2022 in EUR', ' Annual Report 2023. Outlook to 2025', ' FY24 and GBP', ' grew from 1999 to 2031'][doc_id % 5 + 1] || ' paid $5 or INR 7, year ended May 1, 2020' as text from documents)
select doc_id, {_YEAR} as financial_year, {_PERIOD} as report_period, {_CURRENCY} as currency, coalesce({_DATES}[1], '') as fiscal_year_start, coalesce({_DATES}[-1], '') as fiscal_year_end from d""",
    "chunk_entities": rf"""with {_D}, c as (select doc_id, text as t0, text || chr(10) || 'Partners include Alpha Steel, Beta Mills; CEO Jane Doe leads. The ticker: ABC. Sold in Germany and India. See the chart and footnote 3. Unaudited guidance, litigation. Growth of 5% in ' || company as t from d)
select doc_id, {_named('t', 'companies|organizations|partners|customer|customers')} as organizations, {_named('t', 'products|services|platforms|offerings')} as products, {_named('t', 'segments|business segments|operating segments')} as business_segments,
  'Jane Doe' as people, 'Germany,India' as countries, regexp_extract(t, '\b(?:ticker|symbol)\s*[:-]\s*([A-Z]{{1,5}})\b', 1) as company_ticker,
  len(regexp_extract_all(t, '(?i)\b(?:revenue|operating income|gross profit|gross margin|ebitda|ebit|cash flow|free cash flow|eps|diluted eps|capex|r&d|research and development|share repurchases?|dividend|tax expense|net income|working capital|debt|equity|inventory|accounts receivable|accounts payable|goodwill|intangible assets|segment revenue|operating margin|return on equity|return on assets|liquidity|leverage|growth rate|growth|assets|liabilities)\b[^\n]{{0,45}}?(?:[-−(]?[$€£₹]?[\d,.]+(?:\s*(?:million|billion|bn|m|b))?%?[)]?)')) as n_values,
  {_terms('t', ['investment', 'capital expenditure', 'share buyback', 'share repurchase', 'dividend', 'guidance'])} as investment_keywords, {_terms('t', ['cybersecurity', 'competition', 'regulation', 'inflation', 'interest rates', 'supply chain', 'litigation'])} as risks,
  {_terms('t', ['audited', 'unaudited'])} as is_audited, true as contains_chart, true as contains_footnotes,
  case when regexp_matches(t0, '(?i)\b(assets|liabilities|cash flow|income|revenue|equity|balance sheet)\b') then 'financials' when regexp_matches(t0, '(?i)\b(risk|uncertainty|material|litigation|regulatory)\b') then 'risk' else 'content' end as passage_section from c""",
    "chunk_id_hashes": "select doc_id, i // 800 as chunk_index, sha256('/' || doc_id || '::' || coalesce(source, '') || '::' || (i // 800)) as chunk_hash from documents, unnest(range(0, length(text), 800)) t(i)",
    "passage_risks": rf"""with {_D}, pg as (select doc_id, cast((i - 1) // 2 + 1 as int) as page_number, string_agg(x, chr(10) || chr(10) order by i) as text
  from (select doc_id, i, string_split(text, chr(10) || chr(10))[i] as x from d, unnest(range(1, len(string_split(text, chr(10) || chr(10))) + 1)) t(i)) group by 1, 2),
s as (select doc_id, page_number, unnest(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1))) as e from pg),
r as (select unnest(['Debt', 'Liquidity', 'Profitability', 'Revenue', 'Cash Flow', 'Auditor', 'Legal', 'Accounting', 'Corporate Governance']) as category, unnest(['\b(debt|borrowings?|leverage)\b', '\b(liquidity|working capital)\b', '\b(loss|margins?)\b', '\brevenue (fell|declined|dropped)\b', '\bcash flow\b',
  '\b(qualified opinion|going concern|material weakness)\b', '\b(litigation|lawsuit|legal proceedings)\b', '\b(restatement|impairment)\b', '\b(governance|related party)\b']) as p)
select doc_id, page_number, category, md5(e) as evidence_md5 from s, r where trim(e) <> '' and regexp_matches(lower(e), p)""",
    "repeated_headers": rf"""with {_PAGES}, l as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(trim(regexp_replace(x, '\s+', ' ', 'g')), '(?i)^\s*(?:page\s*)?\d{{1,4}}\s+', ''), '^[,;:\- ]+|[,;:\- ]+$', '', 'g')), lambda x: x <> '') as l from pages),
e as (select doc_id, unnest(list_concat(l[1:2], l[greatest(1, len(l) - 1):len(l)])) as line from l)
select doc_id, line, count(*) as n from e where len(string_split(line, ' ')) <= 10 group by 1, 2 having count(*) >= 2""",
}
