import pytest
from pyspark.sql import functions as F

from argosy.functions import tags
from argosy.functions import text as tx
from argosy.operators import audit, chunk, compare, extract, redflag, research, retrieve
from argosy.sources import files


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "text STRING").select(column(F.col("text")).alias("x")).first().x


def test_word_windows(spark):
    assert one(spark, "a b c d e", lambda c: tx.word_windows(c, 3, 1)) == ["a b c", "c d e", "e"]
    assert one(spark, "  ", lambda c: tx.word_windows(c, 3, 1)) == []
    assert one(spark, None, lambda c: tx.word_windows(c, 3, 1)) == []
    with pytest.raises(ValueError):
        tx.word_windows(F.col("text"), 3, 3)


def test_decompose(spark):
    assert one(spark, "research and development; margins?", tx.decompose) == ["research", "development", "margins"]
    assert one(spark, " ? ", tx.decompose) == ["?"]


def test_clean_and_measures(spark):
    assert one(spark, "a​  b\t c\n\n\n\nd ", tx.clean_text) == "a b c\n\nd"
    assert one(spark, "\n abc \n", tx.clean_text) == "abc" and one(spark, "\n\n", tx.clean_text) == ""
    assert one(spark, " Notes  on it - ", tx.normalize_heading) == "Notes on it" and one(spark, "Notes: -", tx.normalize_heading) == "Notes:"
    assert one(spark, "x" * 221, tx.snippet) == "x" * 220 + tx.ELLIPSIS


def test_tags(spark):
    assert one(spark, "Form 10-K for 2023", tags.report_type) == "10-K"
    assert one(spark, None, tags.report_type) == "Other"
    assert one(spark, "a | 1\nb | 2", tags.block_type) == "table"
    assert one(spark, "Risk Factors", tags.block_type) == "heading"
    assert one(spark, "- item", tags.block_type) == "list"
    assert one(spark, "net income and EBITDA", tags.financial_metrics) == "EBITDA,Net Income"
    assert one(spark, "fiscal year ended June 30, 2024", lambda c: tags.financial_year(c, 2026)) == 2024
    assert one(spark, "Annual Report 2023. Outlook to 2025.", lambda c: tags.financial_year(c, 2026)) == 2023
    assert one(spark, "Results of FY24", lambda c: tags.financial_year(c, 2026)) == 2024
    assert one(spark, "from 1985 to 2019 and 2050", lambda c: tags.financial_year(c, 2026)) == 2019
    assert one(spark, "Litigation costs", tags.infer_section) == "risk" and one(spark, "Total Assets", tags.infer_section) == "financials"
    assert tuple(one(spark, "Our Outlook Today\ntext.", tags.section_heading)) == ("Our Outlook Today", "other")


def test_pack(spark):
    from pyspark.sql import functions as F

    pack = lambda parts, *how: spark.createDataFrame([(parts,)], "p ARRAY<STRING>").select(chunk.packed(F.col("p"), *how)).first()[0]
    assert pack(["aa", "bb", "cc"], 4, False, "-") == ["aa-bb", "cc"]
    assert pack(["a b", "c d"], 3, True, " ", 1) == ["a b", "b c d"]
    assert pack([], 4, False, "-") == []


def test_drop_known(spark):
    d = spark.createDataFrame([(1, "b", "h"), (2, "a", "h"), (3, "c", "k")], "doc_id INT, source STRING, doc_hash STRING")
    known = spark.createDataFrame([("k",)], "doc_hash STRING")
    assert [r.doc_id for r in chunk.drop_known(d, known).collect()] == [2]


def test_margins(spark):
    pages = [("d", p, f"Header\nbody {p}\nFooter") for p in range(1, 5)] + [("e", 1, "Header")]
    got = {(r.doc_id, r.page_number): r.text for r in chunk.strip_repeated_margins(spark.createDataFrame(pages, "doc_id STRING, page_number INT, text STRING")).collect()}
    assert got == {("d", p): f"body {p}" for p in range(1, 5)} | {("e", 1): "Header"}


def test_margins_leave_the_rest(spark):
    """Documents under three pages and blank lines stay; a page of nothing but margins becomes empty."""
    pages = [("two", 1, "Top\n\n a \nEnd"), ("two", 2, "")] + [("d", p, f"Top\n\n body {p} \n\nx\ny\nEnd") for p in range(1, 4)] + [("d", 4, "Top\nEnd\n")]
    got = {(r.doc_id, r.page_number): r.text for r in chunk.strip_repeated_margins(spark.createDataFrame(pages, "doc_id STRING, page_number INT, text STRING")).collect()}
    assert got == {("two", 1): "Top\n\n a \nEnd", ("two", 2): "", ("d", 4): ""} | {("d", p): f"\n body {p} \n" for p in range(1, 4)}


def test_windows_of_characters(spark):
    import random

    r = random.Random(3)
    texts = ["".join(r.choice("ab é\n😀") for _ in range(r.randint(0, 60))) for _ in range(40)] + [None, "", "x" * 50, "x" + " " * 30]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING")
    for size, overlap in ((10, 3), (10, 9), (7, 0)):
        got = {}
        for row in chunk.char_chunks(d, size, overlap).collect():
            got.setdefault(row.doc_id, {})[row.chunk_index] = row.text
        for i, t in enumerate(texts):
            assert list(dict(sorted(got.get(i, {}).items())).values()) == [(t or "")[a : a + size] for a in range(0, len(t or ""), size - overlap)]
        for row in chunk.wordsafe_chunks(d, size, overlap).collect():
            assert row.text == row.text.strip() and 0 < len(row.text) <= size and row.text in texts[row.doc_id]
    assert [r.text for r in chunk.wordsafe_chunks(spark.createDataFrame([(1, "one two three four")], "doc_id INT, text STRING"), 9, 2).orderBy("chunk_index").collect()] == ["one two", "wo three", "ee four"]


def test_wordsafe_windows_go_by_rows(spark):
    """Texts reach Python by the hundred and not by Arrow batches of ten thousand, and workers need no pandas for it."""
    d = spark.createDataFrame([(1, "one two three four"), (2, None), (3, "")], "doc_id INT, text STRING")
    got = chunk.wordsafe_chunks(d, 9, 2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan and not hasattr(chunk, "pd")
    assert sorted((r.doc_id, r.chunk_index, r.total_chunks, r.text) for r in got.collect()) == [(1, 0, 3, "one two"), (1, 1, 3, "wo three"), (1, 2, 3, "ee four")]


def test_known_paths(spark):
    d = spark.createDataFrame([("c", "a.txt", "x\n\ny" + "z" * 1300), ("c", "b.txt", "n"), ("k", "a.txt", "n"), ("c", "e.txt", None)], "collection STRING, source_file STRING, text STRING")
    held = spark.createDataFrame([("c", "a.txt"), ("c", "e.txt")], "collection STRING, source_file STRING")
    new, again = chunk.drop_known_paths(d, held)
    assert sorted((r.collection, r.source_file) for r in new.collect()) == [("c", "b.txt"), ("k", "a.txt")]
    assert sorted((r.source_file, r.skipped_chunks) for r in again.collect()) == [("a.txt", 2), ("e.txt", 0)]


def test_infer_company_and_retrieve(spark):
    chunks = spark.createDataFrame([("1", "Acme", "total revenue", 1), ("2", "Beta Corp International", "debt", 2), ("3", "Acme", "other", 3)], "chunk_id STRING, company STRING, text STRING, chunk_order INT")
    q = spark.createDataFrame([("a", "revenue of acme"), ("b", "debt of beta corp international?"), ("c", "weather")], "qid STRING, sub_question STRING")
    named = retrieve.infer_company(q, chunks)
    assert {r.qid: r.company for r in named.collect()} == {"a": "Acme", "b": "Beta Corp International", "c": None}
    got = {(r.qid, r["rank"]): r.chunk_id for r in retrieve.retrieve(named, chunks, 2).collect()}
    assert got == {("a", 1): "1", ("a", 2): "3", ("b", 1): "2", ("c", 1): "1", ("c", 2): "2"}


def test_research_without_evidence(spark):
    q = spark.createDataFrame([(1, "debt of Acme?")], "question_id INT, question STRING")
    chunks = spark.createDataFrame([], "chunk_id STRING, company STRING, text STRING, chunk_order INT")
    cited = research.evidence(q, chunks)
    assert research.NO_EVIDENCE in research.answers(cited, q).first().answer
    assert "Sub-question: debt of Acme" in research.prompts(cited, q).first().prompt


def test_better(spark):
    rows = [(1.0, 2.0), (2.0, 1.0), (None, 1.0), (float("nan"), 1.0), (1.0, 1.0)]
    got = spark.createDataFrame(rows, "a DOUBLE, b DOUBLE").select(compare.better(F.col("a"), F.col("b"), F.lit("A"), F.lit("B")).alias("w")).collect()
    assert [r.w for r in got] == ["B", "A", "Equal", "Equal", "Equal"]


def test_labelled_metrics(spark):
    d = spark.createDataFrame([(1, "Company: Acme\nRevenue: $5 million")], "doc_id INT, text STRING")
    got = {r.metric: r.value for r in extract.labelled_metrics(d).collect()}
    assert got["Company"] == "Acme" and got["Revenue"] == "$5 million" and got["EPS"] == extract.NOT_FOUND


@pytest.mark.parametrize("text,level", [("Borrowings rose. Liquidity needs review.", "Medium"), ("Revenue fell and margins were reduced.", "High"), ("A debt.", "Low"), (None, "Low")])
def test_rule_flags(spark, text, level):
    flags = redflag.rule_flags(spark.createDataFrame([("c", text)], "company STRING, text STRING"))
    assert redflag.risk_rollup(flags, "company").first().overall_risk == level


def test_responses(spark):
    full = '{"category": "Debt", "severity": "High", "title": "t", "description": "d", "reason": "r", "evidence": "e", "page": 3, "recommendation": "x", "confidence": 0.5}'
    texts = [f'{{"flags": [{full}]}}', 'so: ```json\n{"flags": [{"category": "Legal"}]}\n```', f"[{full}]", f'note {{x}} then {{"flags": [{full}]}}', f'see {{"flags": [{full}]}} or {{y}}', "none", None, '{"flags": [', '{"flags": []}']
    got = {r.i: (r.category, r.page, r.valid) for r in redflag.flags_of_responses(spark.createDataFrame(list(enumerate(texts)), "i INT, response STRING")).collect()}
    none, debt = (None, None, False), ("Debt", 3, True)
    assert got == {0: debt, 1: ("Legal", None, False), 2: debt, 3: debt, 4: debt, 5: none, 6: none, 7: none, 8: none}
    contexts = spark.createDataFrame([(5, "Debt rose"), (0, "Debt rose")], "i INT, text STRING")
    found = redflag.flags_or_rules(spark.createDataFrame([(0, texts[0]), (5, "none")], "i INT, response STRING"), contexts, "i").collect()
    assert sorted((r.i, r.category, r.model_used) for r in found) == [(0, "Debt", "model"), (5, "capital_structure", "offline-fallback")]


def test_analyze(spark):
    chunks = spark.createDataFrame([("c", "1", 1, "Acme", "debt of the company"), ("c", "2", 2, "Beta", "financial report risks fell"), ("k", "3", 1, "Acme", "calm")], "collection STRING, chunk_id STRING, chunk_order INT, company STRING, text STRING")
    asked = spark.createDataFrame([("Acme", "c"), ("Acme", "k"), ("Acme", "none"), (" ", "c")], "company STRING, collection STRING")
    found, refused = redflag.analyze(asked, chunks, 2)
    assert sorted((r.collection, r.overall_risk, r.total_flags, r.flags[0].page) for r in found.collect()) == [("c", "High", 2, None), ("k", "Low", 1, None)]
    assert sorted(r.reason for r in refused.collect()) == ["collection is unknown", "company is blank"]
    best = retrieve.retrieve_for_company(asked.filter("collection = 'c'").filter("company = 'Acme'"), chunks, 1).collect()
    assert [(r.chunk_id, r.chunk_company) for r in best] == [("2", "Beta")]
    own = retrieve.retrieve_for_company(asked.filter("collection = 'c'").filter("company = 'Acme'"), chunks, 1, scoped=True).collect()
    assert [r.chunk_id for r in own] == ["1"]


def test_audit(spark):
    c = spark.createDataFrame([("1", "", "2"), ("2", "1", "9")], "chunk_id STRING, previous_chunk_id STRING, next_chunk_id STRING")
    assert [(r.chunk_id, r.link) for r in audit.broken_links(c).collect()] == [("2", "9")]
    assert audit.missing_fields(c, ["text", "chunk_id"]) == ["text"]
    empty = spark.createDataFrame([], "company STRING")
    assert [(r.field, r.missing, r.share) for r in audit.completeness(empty, ["company"]).collect()] == [("company", 0, 0.0)]


def test_files(spark, tmp_path):
    (tmp_path / "b.txt").write_bytes(b"caf\xc3\xa9  \xff text")
    (tmp_path / "a.PDF").write_bytes(b"x")
    (tmp_path / "c.csv").write_text("Metric,Value\nRevenue,5\n")
    assert [r.path.rsplit("/", 1)[1] for r in files.discover_files(spark, str(tmp_path)).collect()] == ["a.PDF", "b.txt"]
    assert [r.text for r in files.read_text_docs(spark, str(tmp_path / "b.txt")).collect()] == ["café text"]
    (tmp_path / "d.txt").write_bytes(b"caf\xc3\xa9  \xfe text")
    (tmp_path / "e.txt").write_bytes(b"\n \n")
    hashes = {r.source_file: r.doc_hash for r in files.read_text_docs(spark, str(tmp_path / "*.txt")).collect()}
    assert set(hashes) == {"b.txt", "d.txt"} and len(set(hashes.values())) == 2
    assert files.read_metric_csv(spark, str(tmp_path / "c.csv")).first().value == 5.0
    old = spark.createDataFrame([("x", 1), ("y", 1)], "source STRING, n INT")
    new = spark.createDataFrame([("x", 2)], "source STRING, n INT")
    assert sorted((r.source, r.n) for r in files.replaced(old, new).collect()) == [("x", 2), ("y", 1)]


def test_requests(spark):
    r = spark.createDataFrame([("Acme", "c"), (" ", "c"), ("Acme", "d"), ("Acme", None)], "company STRING, collection STRING")
    known = spark.createDataFrame([("c",)], "collection STRING")
    assert sorted(str(x.reason) for x in files.validate_requests(r, known).collect()) == ["None", "collection is blank", "collection is unknown", "company is blank"]


@pytest.mark.parametrize(
    "text,name",
    [
        ("Annual Report\nExample Manufacturing Holdings Ltd.\nFor the year ended March 31, 2024", "Example Manufacturing Holdings Ltd."),
        ("Microsoft Annual Report 2024\nGitHub Copilot and cloud grew.", "Microsoft"),
        ("This company continues to deliver long sentences about what it does for its customers every day of the year.", ""),
        ("", ""),
    ],
)
def test_company_names(spark, text, name):
    from argosy.operators.company import company_names

    got = company_names(spark.createDataFrame([(1, 1, text)], "doc_id INT, page_number INT, text STRING")).first()
    assert got.company == name


def test_document_columns(spark):
    from argosy.operators.metadata import document_columns, financial_values, named_values

    text = "Acme Annual Report 2024\nFiled: March 3, 2024. Year ended June 30, 2023. Sector: Retail trade\nTotal revenue was $1,200 million"
    cols = document_columns(F.col("t"), 2026)
    r = spark.createDataFrame([(text,)], "t STRING").select(*(v.alias(k) for k, v in cols.items()), financial_values(F.col("t")).alias("v"), named_values(F.lit("Products include Alpha Suite, Beta; more"), ("products",)).alias("n")).first()
    assert (r.document_title, r.filing_date, r.report_period, r.currency, r.industry, r.financial_year) == ("Acme Annual Report 2024", "March 3, 2024", "June 30, 2023", "USD", "Retail trade", 2023)
    assert r.v == ["revenue was $1,200 million"] and r.n == "Alpha Suite,Beta"


def test_layout_chunks(spark):
    from argosy.operators.layout import layout_chunks

    text = "Risk Factors\n\nDebt rose.\n\nA | 1\nB | 2\n\none two three four five six.\n\nseven eight nine ten."
    got = layout_chunks(spark.createDataFrame([(1, 1, text), (2, 1, "")], "doc_id INT, page_number INT, text STRING"), 7, 2).orderBy("chunk_index").collect()
    assert [(r.block_types, r.text) for r in got] == [(["narrative"], "Risk Factors\n\nDebt rose."), (["table"], "A | 1\nB | 2"), (["narrative"], "one two three four five six."), (["narrative"], "five six.\n\nseven eight nine ten.")]
    assert {r.section_title for r in got} == {"Risk Factors"} and got[0].page_numbers == [1]


def test_layout_rules(spark):
    """Sections go on over pages; the second of two headings is taken in and sets no section; lists stand alone and take no
    words over; tables part under their first row with their empty cells."""
    from argosy.operators import layout

    pages = [(1, 1, "Balance Sheets\n\nRisk Factors\n\nfirst words here."), (1, 2, "more text on page two.\n\n- a list item\n\nlast of all."), (1, 3, "h | x\na || 1\nb\t\t2\nc  d  3")]
    d = spark.createDataFrame(pages, "doc_id INT, page_number INT, text STRING")
    got = [(r.text, r.block_types, r.page_numbers, r.section_title) for r in layout.layout_chunks(d, 9, 2).orderBy("chunk_index").collect()]
    b = "Balance Sheets"
    assert got == [
        ("Balance Sheets\n\nRisk Factors\n\nfirst words here.", ["narrative"], [1], b),
        ("words here.\n\nmore text on page two.", ["narrative"], [1, 2], b),
        ("- a list item\n\nlast of all.", ["list", "narrative"], [2], b),
        ("h | x\na |  | 1", ["table"], [3], b),
        ("h | x\nb |  | 2", ["table"], [3], b),
        ("h | x\nc | d | 3", ["table"], [3], b),
    ]
    carried = layout.section_carry(layout.blocks(d)).orderBy("page_number", "pos").collect()
    assert [(r.page_number, r.section_title) for r in carried] == [(1, "Balance Sheets"), (1, "Risk Factors"), (1, "Risk Factors"), (2, "Risk Factors"), (2, "Risk Factors"), (2, "Risk Factors"), (3, "Risk Factors")]
    assert [r.page_number for r in layout.block_chunks(d).orderBy("chunk_index").collect()] == [1, 1, 3]


def test_chunk_metadata(spark):
    """All columns of the contract, once, with what a table chunk and a plain one say."""
    from argosy.operators import metadata

    chunks = [(1, "1-0", 0, 2, "Revenue | 2023 | 2024\nSales | 10 | 12\nDebt | 5 | 6", [1, 10, 2], ["table"], "Balance Sheets", "financial_statement"), (1, "1-1", 1, 2, "CEO Jane Doe leads in India. See chart. ticker: ABC. Audited.", [2], ["narrative"], "", "other")]
    c = spark.createDataFrame(chunks, "doc_id INT, chunk_id STRING, chunk_index INT, total_chunks INT, text STRING, page_numbers ARRAY<INT>, block_types ARRAY<STRING>, section_title STRING, section_type STRING")
    d = spark.createDataFrame([(1, "Acme Annual Report 2024\nusd", "Acme", "a.txt", "h", "s")], "doc_id INT, text STRING, company STRING, source STRING, doc_hash STRING, analysis_id STRING")
    rows = {r.chunk_id: r for r in metadata.chunk_metadata(c, d, 2026).collect()}
    fields = """analysis_id source doc_hash chunk_id chunk_index total_chunks previous_chunk_id next_chunk_id page_start page_end page_numbers content_length word_count sentence_count paragraph_count reading_time
    reading_time_seconds document_title report_title document_language report_type financial_year report_period filing_date fiscal_year_start fiscal_year_end currency document_version section_title section_type
    chunk_type chunk_summary industry company_name company_ticker confidence_score semantic_tags organizations people products countries financial_metrics financial_entities financial_values business_segments
    investment_keywords risks contains_table table_type contains_financial_table table_rows table_columns contains_chart contains_footnotes is_audited ingestion_timestamp""".split()
    a, b = rows["1-0"], rows["1-1"]
    assert len(fields) == 56 and set(fields) <= set(a.asDict())
    assert (a.page_start, a.page_end, a.page_numbers, a.contains_financial_table, a.table_type, a.table_rows, a.table_columns, a.chunk_type) == (1, 10, "1,10,2", "true", "Income Statement", 3, 3, "financial_table")
    assert (b.company_ticker, b.people, b.countries, b.contains_table, b.chunk_type, b.is_audited, b.currency, b.financial_year) == ("ABC", "Jane Doe", "India", "false", "narrative", "audited", "usd", 2024)
    assert (a.chunk_summary, b.confidence_score, a.confidence_score) == ("Discusses debt,revenue.", 0.75, 1.0)


def test_candidates(spark):
    """Words that come often, lines at the edges of pages and fields of a file name a company."""
    from argosy.operators import company

    pages = spark.createDataFrame([(1, 1, "Acme Steel Corp\nBody one.\nPage end"), (1, 2, "Acme Steel Corp\nAcme Steel Corp\nPage end"), (2, 1, "alone")], "doc_id INT, page_number INT, text STRING")
    heads = {(r.doc_id, r.line): r.n for r in company.repeated_headers(pages).collect()}
    assert heads == {(1, "Acme Steel Corp"): 4, (1, "Body one."): 2, (1, "Page end"): 2, (2, "alone"): 2}
    often = company.frequency_candidates(spark.createDataFrame([(1, "Acme Steel Corp. Acme Steel Corp. and Acme Steel Corp, Beta")], "doc_id INT, cover STRING")).collect()
    assert [(r.name, r.n) for r in often] == [("Acme Steel Corp", 3)]
    titles = spark.createDataFrame([(2, "Zeta Holdings")], "doc_id INT, value STRING")
    found = [r for r in company.candidates(pages, titles).collect() if r.source == "document_metadata"]
    assert [(r.doc_id, r.name) for r in found] == [(2, "Zeta Holdings")]


def test_texts_are_read_once_for_names(spark):
    """The texts are read by one pass for all places, by one for repeated headers and by one for the ids; a name counts in each."""
    from argosy.operators import company

    text = "Acme Steel Corp\nAcme Steel Corp Annual Report 2024\nIssuer: Acme Steel Corp\nSteel grew."
    pages = spark.createDataFrame([(1, 1, text), (2, 1, None), (None, 1, text)], "doc_id INT, page_number INT, text STRING")
    plan = company.company_names(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 3
    got = {(r.source, r.i, r.n, r.c) for r in company.candidates(pages).filter("doc_id = 1 AND name = 'Acme Steel Corp'").collect()}
    # the evidence is the page twice; of a page's three lines with the name the first and last are taken, the second as a title
    assert got == {("title", 1, 1, 2), ("first_page", 0, 1, 2), ("cover", 0, 1, 4), ("issuer", 2, 1, 2), ("frequency", 20, 6, 1)}
    assert {(r.doc_id, r.company) for r in company.company_names(pages).collect()} == {(1, "Acme Steel Corp"), (2, ""), (None, "")}


def test_stores(spark, tmp_path):
    import json

    name = "argosy_test_chunks"
    files.drop_collection(spark, name)
    assert files.create_or_get(spark, name).count() == 0 and files.create_or_get(spark, name).count() == 0
    assert name in files.collection_names(spark) and files.drop_collection(spark, name) and not files.drop_collection(spark, name)
    manifest = files.seed_manifest(spark, [("a.txt", "Acme", "Annual Report", "FY2024")])
    d = spark.createDataFrame([(1, "a.txt", "net  income\nrose"), (2, "b.txt", "x")], "doc_id INT, source_file STRING, text STRING")
    assert [(r.chunk_id, r.company, r.section, r.text) for r in files.index_chunks(d, manifest).collect()] == [("1-0", "Acme", "Income Statement", "net income rose")]
    docs, chunks = files.stored_pair(d.withColumnRenamed("source_file", "source").unionByName(spark.createDataFrame([(3, "c", " \n")], "doc_id INT, source STRING, text STRING")), d.withColumnRenamed("source_file", "source"))
    assert {r.doc_id: r.status for r in docs.collect()} == {1: "processed", 2: "processed", 3: "failed"}
    assert {r.doc_id: json.loads(r.metadata)["length"] for r in chunks.collect()} == {1: 16, 2: 1}
    files.write_json(spark.createDataFrame([("Revenue", None)], "metric STRING, value DOUBLE"), str(tmp_path / "j"))
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "j")).collect()] == [{"metric": "Revenue", "value": None}]
    t = spark.createDataFrame([("1", "s", "x"), ("2", None, "y")], "chunk_id STRING, analysis_id STRING, text STRING")
    assert [r.chunk_id for r in retrieve.session(t, "s").collect()] == ["1"] and retrieve.sample_one(t, {"absent": 1}).count() == 0
    assert retrieve.get(t, {"text": "y"}, 5, ["text"]).columns == ["chunk_id", "text"]
    m = files.ingest_manifest(spark.createDataFrame([(1, "h", "x", "bad", 1.239)], "doc_id INT, doc_hash STRING, text STRING, error STRING, seconds DOUBLE"), spark.createDataFrame([], "doc_hash STRING"), spark.createDataFrame([], "doc_id INT")).first()
    assert (m.status, m.error, m.seconds, m.chunks) == ("error", "bad", 1.24, 0)


def test_hooks(spark):
    from argosy.functions import hooks

    d = spark.createDataFrame([(1, "debt rose"), (2, "revenue fell"), (3, "debt rose again"), (4, "")], "vec_id INT, text STRING")
    v = hooks.embed(d).select("vec_id", "embedding")
    q = v.filter("vec_id = 1").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    assert [r.vec_id for r in retrieve.vector_top_k(q, v, 2).orderBy("rank").collect()] == [1, 3]
    assert [len(r.embedding) for r in hooks.embed_with(d, lambda t: [[float(len(x))] for x in t]).collect()] == [1] * 4
    assert hooks.generate(spark.createDataFrame([("hi",)], "prompt STRING"), lambda p: [x.upper() for x in p]).first().answer == "HI"
    f = spark.createDataFrame([("a", b"one|two")], "path STRING, content BINARY")
    assert [(r.page_number, r.text) for r in hooks.read_pages(f, lambda b: b.decode().split("|")).collect()] == [(1, "one"), (2, "two")]


def test_title_field_alone(spark):
    """A title field earns no bonus for its place, so alone it does not name the company; beside the cover it does."""
    from pyspark.sql import functions as F

    from argosy.operators import company

    pages = spark.createDataFrame([(1, 1, "nothing of use here, as it seems to be."), (2, 1, "Northwind Trading\nmore of it, as it seems.")], "doc_id INT, page_number INT, text STRING")
    titles = spark.createDataFrame([(1, "Northwind Trading"), (2, "Northwind Trading")], "doc_id INT, value STRING")
    got = {r.doc_id: r.company for r in company.company_names(pages, titles=titles).collect()}
    assert got == {1: "", 2: "Northwind Trading"}
    score = {r.doc_id: r.score for r in company.scored(company.candidates(pages, titles)).filter(F.col("name") == "Northwind Trading").collect()}
    assert score[1] == 0.40


def test_white_space_of_all_scripts(spark):
    from pyspark.sql import functions as F

    from argosy.functions import tags
    from argosy.functions import text as tx

    rows = [(0, "a b c"), (1, " x y\x1cz "), (2, "One. Two! Three"), (3, "a\n \nb")]
    df = spark.createDataFrame(rows, "i INT, t STRING")
    got = {r.i: r for r in df.select("i", tx.squash(F.col("t")).alias("s"), F.size(tx.words(F.col("t"))).alias("n"), *(c.alias(k) for k, c in tx.text_measures(F.col("t")).items())).collect()}
    for i, t in rows:
        assert got[i].s == " ".join(t.split()) and got[i].n == len(t.split())
    assert got[2].sentences == 3 and got[3].paragraphs == 2
    t = spark.createDataFrame([("dettes: débt",), ("debt rose",), ("édebt",)], "t STRING").select(tags.first_rule(F.col("t"), [("Debt", r"\bdebt\b")], "").alias("x")).collect()
    assert [r.x for r in t] == ["", "Debt", ""]


def test_evidence_and_file_names(spark):
    from pyspark.sql import functions as F

    from argosy.operators import metadata

    pages = spark.createDataFrame([(1, i, f"page {i}") for i in (3, 1, 2, 4)], "doc_id INT, page_number INT, text STRING")
    p = ["page 1", "page 2", "page 3", "page 4"]
    assert metadata.evidence_text(pages).first().evidence == "\n\n".join(p[:3] + p)
    assert metadata.evidence_text(pages, 20).first().evidence == "\n\n".join(p[:3] + p)[:20]
    names = ["in/annual_report_2023.pdf", "a.b/q3_fy22.tar.gz", "plain", "x/.hidden"]
    df = spark.createDataFrame([(n,) for n in names], "n STRING")
    assert [r.s for r in df.select(metadata.stem(F.col("n")).alias("s")).collect()] == ["annual report 2023", "q3 fy22.tar", "plain", ".hidden"]
    cols = metadata.document_columns(F.lit("Some text"), 2026, F.col("n"))
    assert [(r.y, r.t) for r in df.select(cols["financial_year"].alias("y"), cols["report_type"].alias("t")).collect()] == [(2023, "Annual Report"), (2022, "Quarterly Report"), (None, "Other"), (None, "Other")]


def test_missing_keys(spark):
    from argosy.operators import audit

    df = spark.createDataFrame([('{"a": 1}',), ('{"b": null}',), (None,), ("no json",)], "metadata STRING")
    assert [r.field for r in audit.missing_keys(df, ["a", "b", "c", "d"]).collect()] == ["c", "d"]
    assert [r.field for r in audit.missing_keys(df.limit(0), ["b", "a"]).collect()] == ["a", "b"]


def test_session_counts(spark):
    """Distinct values of sessions over batches, many of them in two: exact, where sketches are some percent off."""
    rows = spark.range(90_000).selectExpr("id % 3 AS batch", "nullif(concat('s', id % 2), 's1') AS analysis_id", "concat('d', id % 70000) AS source", "if(id % 5 = 0, '', concat('h', id % 20000)) AS doc_hash", "cast(null AS string) AS company")
    got = {r.session: tuple(r)[1:] for r in audit.session_counts(audit.session_states(rows)).collect()}
    assert got == {"s0": (45_000, 8_000, 35_000, 0), "unknown": (45_000, 8_000, 35_000, 0)}
    about = {r.session: tuple(r)[1:] for r in audit.session_totals(audit.session_sketches(rows)).collect()}
    assert about != got and all(abs(a - b) <= 0.05 * b for s in got for a, b in zip(about[s], got[s], strict=True))


def test_first_rule(spark):
    """Patterns are tried where what they need stands, on a text that is made once."""
    assert [tags.literal(p) for p in (r"\bq[1-4]\b", r"\benvironmental,? social,? and governance report\b", r"risk factors?", r"(?:ab|cd)e{2}f", r"\d+")] == ["q", " and governance report", "risk factor", "f", ""]
    rules = [*tags.REPORT_TYPES, *tags.GUESSES, *tags.PASSAGE_SECTIONS]
    texts = ["", None, "10-K", "x10-k", "Environmental Social, and Governance Report", "Q3 and q5", "INTEGRATED  ANNUAL REPORT", "definitive proxy statement", "risk factor", "éproxy", "Q\u00a03"] + [a for _, p in rules for a in tags.alternatives(p)]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    for some in (tags.REPORT_TYPES, tags.GUESSES, tags.PASSAGE_SECTIONS):
        want = F.coalesce(*(F.when(F.lower("t").rlike(f"(?U){p}"), label) for label, p in some), F.lit("none"))
        assert df.filter(~tags.first_rule(F.col("t"), some, "none").eqNullSafe(want)).count() == 0
    plan = df.select(tags.report_type(F.col("t")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
