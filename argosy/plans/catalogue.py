"""The registered queries over the given tables and their SQL twins for DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argosy.functions import hooks, plan, table_functions, tags
from argosy.functions import text as tx
from argosy.operators import audit, chunk, company, compare, extract, metadata, redflag, research, retrieve, vector_index
from argosy.plans import reports, texts
from argosy.plans.filings import ORACLE as FILINGS_SQL
from argosy.plans.filings import filings
from argosy.session import table, with_checkpoint_dir
from argosy.sources import files, store

AS_OF_YEAR = 2026
#: Percent of the cells that a query of vector_topk_index probes.
PROBES = 50
#: Characters of a part of a company's context: small, so that the given companies have several.
CONTEXT = 1_000


def filing_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings as a document table."""
    return filings(spark, sf_dir).select(F.col("filing_id").alias("doc_id"), "company", "period", "text")


def filing_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings in word windows of 40 with the columns of the chunk contract; a session is a year's last digit."""
    d = filing_docs(spark, sf_dir).withColumns({"doc_hash": F.sha2("text", 256), "text": tx.squash(F.col("text"))})
    c = chunk.word_chunks(d, 40, 10)
    c = c.withColumns({"chunk_order": F.col("doc_id") * 1000 + F.col("chunk_index"), "doc_type": F.lit("Annual Report"), "source_file": F.concat("doc_id", F.lit(".txt"))})
    c = c.withColumns({"source": F.col("source_file"), "analysis_id": F.concat(F.lit("s"), F.col("doc_id") % 10), "financial_year": F.col("doc_id") % 10000, "report_type": tags.report_type(F.col("text"))})
    return c.withColumn("financial_metrics", tags.financial_metrics(F.col("text")))


def stored_filing_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, made once for operators that read it several times."""
    with_checkpoint_dir(spark)
    return filing_chunks(spark, sf_dir).checkpoint()


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question of two parts about each supplier that has filings; only the first part names it."""
    suppliers = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("question_id")).distinct()
    name = F.concat(F.lit("Supplier "), F.col("question_id"), F.lit(" Holdings Ltd"))
    return suppliers.withColumn("question", F.concat(F.lit("What is total revenue for "), name, F.lit(", and what is total debt?")))


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.statement_values(filing_docs(spark, sf_dir).drop("period"))


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redflag.rule_flags(filing_docs(spark, sf_dir).drop("period"))


# Queries


def _document_windows(d: DataFrame) -> DataFrame:
    c = chunk.with_neighbours(chunk.exploded(d, tx.word_windows(F.col("text"), 450, 100)))
    return c.select("doc_id", "chunk_id", "chunk_index", "total_chunks", "previous_chunk_id", "next_chunk_id", F.md5("text").alias("text_md5"), F.length("window_text").alias("window_chars"))


def word_windows_all(spark, sf_dir):
    """Windows of every document, whatever its language."""
    return _document_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))


def char_windows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunk.char_chunks(d).select("doc_id", "chunk_index", F.md5("text").alias("text_md5"))


def clean_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(tx.squash(F.col("text"))).alias("squashed_md5"), F.length(tx.clean_text(F.col("text"))).alias("clean_chars"))


def sentence_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", *(c.cast("long").alias(n) for n, c in tx.text_measures(F.col("text")).items() if n != "reading_seconds"))


def searchable(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "text")).withColumn("page_number", F.col("p") + 1)
    return files.searchable_docs(d)


def filing_lines(spark, sf_dir):
    return values(spark, sf_dir).select("doc_id", "metric", "fy", "amount", "unit", "value")


def metric_trend(spark, sf_dir):
    return extract.metric_trend(values(spark, sf_dir)).select("company", "metric", "fy", "value", "previous", F.round("change", 6).alias("change"), "direction")


def metric_ranking(spark, sf_dir):
    one = values(spark, sf_dir).groupBy("company", "metric", "fy").agg(F.max("value").alias("value"))
    return compare.ranking(one)


def compare_companies(spark, sf_dir):
    v = values(spark, sf_dir).groupBy("company", "metric", "fy").agg(F.max("value").alias("value"))
    side = lambda name: v.filter(F.col("company") == name).select(F.concat("metric", F.lit(" FY"), "fy").alias("metric"), "value")
    return compare.compare_two(side("Supplier 1 Holdings Ltd"), side("Supplier 2 Holdings Ltd"))


def comparison_series(spark, sf_dir):
    return compare.long_form(compare_companies(spark, sf_dir))


def compare_peers(spark, sf_dir):
    v = values(spark, sf_dir).groupBy("company", "metric", "fy").agg(F.max("value").alias("value"))
    return compare.compare_peers(v, "Supplier 1 Holdings Ltd").select("company", "metric", "fy", "own", "value", "winner")


def filing_tags(spark, sf_dir):
    d = filing_docs(spark, sf_dir)
    c = F.col("text")
    return d.select("doc_id", tags.report_type(c).alias("report_type"), tags.guess_section(c).alias("section"), tags.financial_metrics(c).alias("financial_metrics"), tags.semantic_tags(c).alias("semantic_tags"), tags.financial_year(c, AS_OF_YEAR).alias("financial_year"))


def decomposed_questions(spark, sf_dir):
    return research.sub_questions(questions(spark, sf_dir)).select("question_id", "step", "sub_question")


def inferred_companies(spark, sf_dir):
    return retrieve.infer_company(research.sub_questions(questions(spark, sf_dir)), filing_docs(spark, sf_dir)).select("question_id", "step", "company")


def evidence(spark, sf_dir):
    """Evidence of all filings; only the columns that it shows are made of the chunks."""
    with_checkpoint_dir(spark)
    chunks = filing_chunks(spark, sf_dir).select("chunk_id", "chunk_order", "company", "doc_type", "section", "source_file", "text").checkpoint()
    return research.evidence(questions(spark, sf_dir), chunks)


def research_topk(spark, sf_dir):
    return evidence(spark, sf_dir).select("question_id", "step", "rank", "chunk_id", F.round("score", 6).alias("score"), "section")


def citations(spark, sf_dir):
    return research.all_citations(evidence(spark, sf_dir)).select("question_id", "citation_no", "citation", F.md5("snippet").alias("snippet_md5"))


def research_answers(spark, sf_dir):
    q = questions(spark, sf_dir)
    return research.answers(evidence(spark, sf_dir), q)


def risk_rollup(spark, sf_dir):
    return redflag.risk_rollup(flags(spark, sf_dir), "company")


def severity_distribution(spark, sf_dir):
    return redflag.severity_distribution(flags(spark, sf_dir), "company")


def company_contexts(spark, sf_dir):
    c = filing_chunks(spark, sf_dir)
    return redflag.context_parts(c, "company", "chunk_order", CONTEXT).select("company", "part_no", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


def vector_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    q = v.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return retrieve.vector_top_k(q, v, 5).select("query_id", "vec_id", "rank", F.round("distance", 6).alias("distance"))


def _indexed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, vector_index.Index]:
    """Vectors whose id is divisible by 50 as queries, and an index of all vectors with about as many cells as a cell has rows."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    cells = max(2, round(v.count() ** 0.5))
    q = v.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return q, vector_index.build(v, cells)


def vector_topk_index(spark, sf_dir):
    """The nearest of the nearest cells: most of vector_topk (recall is measured in the tests), a part of its work."""
    q, index = _indexed(spark, sf_dir)
    found = vector_index.search(index, q, 5, PROBES * len(index.centroids) // 100 + 1)
    return found.select("query_id", "vec_id", "rank", F.round("distance", 6).alias("distance"))


def vector_topk_index_exact(spark, sf_dir):
    """vector_topk through the index: cells that can't hold a neighbour are not read."""
    q, index = _indexed(spark, sf_dir)
    found = vector_index.search(vector_index.measured(index), q, 5, 4, exact=True)
    return found.select("query_id", "vec_id", "rank", F.round("distance", 6).alias("distance"))


def embedding_dimensions(spark, sf_dir):
    return audit.embedding_dimensions(table(spark, sf_dir, "embeddings"))


def duplicate_hashes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"), F.sha2("text", 256).alias("doc_hash"))
    return audit.duplicate_hashes(d, True)


def tagged_metrics(spark, sf_dir):
    rules = [("Revenue", r"total revenue: \$([\d.,]+)"), ("Debt", r"total debt: \$([\d.,]+)"), ("EPS", r"earnings per share.*?([\d.]+)")]
    return extract.tagged_metrics(filing_chunks(spark, sf_dir), rules)


def company_name(spark, sf_dir):
    pages = filing_docs(spark, sf_dir).select("doc_id", F.lit(1).alias("page_number"), "text")
    return company.company_names(pages)


def company_metrics_wide(spark, sf_dir):
    v = values(spark, sf_dir).groupBy("company", "metric", "fy").agg(F.max("value").alias("value"))
    w = extract.company_metrics_wide(v, ["Total Revenue", "Total Debt", "Total Assets"])
    return w.select("company", *(F.col(f"`{c}`").alias(c.lower().replace(" ", "_")) for c in ("Total Revenue", "Total Debt", "Total Assets")))


def replaced_sources(spark, sf_dir):
    """Documents in a store, of whose first source a new batch under new ids takes the place."""
    d = table(spark, sf_dir, "documents").select(F.lit("all").alias("collection"), "source", "doc_id")
    path = f"{with_checkpoint_dir(spark).sparkContext.getCheckpointDir()}/stores/{uuid.uuid4()}"
    store.append(d, path, "first")
    first = d.agg(F.min("source").alias("_first"))
    store.replace(d.join(F.broadcast(first), F.col("source") == F.col("_first")).select("collection", "source", (-F.col("doc_id") - 1).alias("doc_id")), path, "second")
    return store.read(spark, path).select("source", "doc_id")


def hashed_and_stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents with doc_hash, and the hashes of those that labels covers, which stand for the store."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.sha2("text", 256).alias("doc_hash"))
    return d, d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_hash")


def doc_hash_dedupe_stored(spark, sf_dir):
    d, known = hashed_and_stored(spark, sf_dir)
    return chunk.drop_known(d.drop("text"), known)


def replaced_sources_whole(spark, sf_dir):
    """The new batch is all of the first source, under new ids."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id")
    first = d.agg(F.min("source").alias("_first"))
    new = d.join(F.broadcast(first), F.col("source") == F.col("_first")).select("source", (-F.col("doc_id") - 1).alias("doc_id"))
    return files.replaced(d, new)


def cascade_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return files.cascade_delete(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), gone, "l_orderkey")


def doc_hash_dedupe(spark, sf_dir):
    """The store holds the documents that labels covers."""
    return doc_hash_dedupe_stored(spark, sf_dir)


def word_windows(spark, sf_dir):
    return _document_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))


def word_windows_sql(spark, sf_dir):
    """word_windows as SQL calls it."""
    table_functions.register(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spark.sql("SELECT doc_id, chunk_index, md5(text) AS text_md5 FROM word_windows(TABLE(SELECT * FROM {docs}), 450, 100)", docs=docs)


def wordsafe_windows_sql(spark, sf_dir):
    """wordsafe_windows as SQL calls it."""
    table_functions.register(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spark.sql("SELECT doc_id, chunk_index, char_length(text) AS chars, md5(text) AS text_md5 FROM wordsafe_windows(TABLE(SELECT * FROM {docs}), 1000, 200)", docs=docs)


def compare_all(spark, sf_dir):
    """Every company against the one that leads a metric and year."""
    return compare.compare_with_leader(values(spark, sf_dir).groupBy("company", "metric", "fy").agg(F.max("value").alias("value")))


def research_prompts(spark, sf_dir):
    q = questions(spark, sf_dir)
    return research.prompts(evidence(spark, sf_dir), q).select("question_id", F.md5("prompt").alias("prompt_md5"))


def rule_flags(spark, sf_dir):
    f = flags(spark, sf_dir)
    return f.select("doc_id", "category", "severity", "title", "confidence", "description", "reason", "recommendation", F.md5("evidence").alias("evidence_md5"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flags of filings as a model might answer them, in seven forms by filing; the last two have none."""
    f = redflag.rule_flags(filing_docs(spark, sf_dir).select("doc_id", "text"))
    one = F.struct("category", "severity", "title", "description", "reason", "evidence", "recommendation", "confidence")
    listed, whole = F.to_json(F.array(one)), F.to_json(F.struct(F.array(one).alias("flags")))
    shapes = [whole, F.concat(F.lit("Here:\n```json\n"), whole, F.lit("\n```")), F.concat(F.lit("I found "), whole, F.lit(" in it, and {more}.")), listed, F.concat(F.lit("note {x} then "), whole), F.lit("no flags"), F.lit("{\"flags\": [")]
    return f.select("doc_id", F.col("category").alias("asked"), F.get(F.array(*shapes), (F.col("doc_id") % len(shapes)).cast("int")).alias("response"))


def response_flags(spark, sf_dir):
    return redflag.flags_of_responses(responses(spark, sf_dir)).select("doc_id", "asked", "category", "severity", "confidence", "valid")


def response_fallback(spark, sf_dir):
    """The flags of the first answer about each filing, those of the rules where it has no JSON."""
    r = responses(spark, sf_dir).groupBy("doc_id").agg(F.min_by("response", "asked").alias("response"))
    return redflag.flags_or_rules(r, filing_docs(spark, sf_dir).select("doc_id", "text"), "doc_id").select("doc_id", "category", "severity", "confidence", "model_used")


def risk_prompts(spark, sf_dir):
    return research.risk_prompts(filing_chunks(spark, sf_dir).withColumnRenamed("chunk_order", "rank"), "company", budget=CONTEXT).select("company", "part_no", F.md5("prompt").alias("prompt_md5"))


def quality_totals(spark, sf_dir):
    return audit.quality_totals(filing_chunks(spark, sf_dir)).withColumn("avg_chunk_words", F.round("avg_chunk_words", 6))


def distinct_values(spark, sf_dir):
    return audit.distinct_values(filing_chunks(spark, sf_dir), ["company", "report_type", "financial_year"])


def distinct_companies(spark, sf_dir):
    return audit.distinct_companies(filing_chunks(spark, sf_dir))


def metadata_completeness(spark, sf_dir):
    c = chunk.with_neighbours(filing_chunks(spark, sf_dir)).withColumnRenamed("company", "company_name")
    return audit.completeness(c)


def missing_fields(spark, sf_dir):
    """Fields that the metadata of no stored chunk has; a source is one only where a document has it."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    _, chunks = files.stored_pair(d, chunk.char_chunks(d))
    return audit.missing_keys(chunks, ["source", "length", "doc_hash", "page_number", "company_index"])


def session_breakdown(spark, sf_dir):
    return audit.session_breakdown(filing_chunks(spark, sf_dir))


def session_estimates(spark, sf_dir):
    """The sessions of chunks that came in a batch for each year, from what is kept of each batch alone; exact, as estimates by
    sketches (audit.session_totals) differ with the hash that makes them."""
    c = filing_chunks(spark, sf_dir).withColumn("batch", F.col("financial_year"))
    return audit.session_counts(audit.session_states(c))


def embedded_retrieval(spark, sf_dir):
    """The four nearest to each question, of the chunks in the nearest cells, by embeddings whose weights are those of the chunks."""
    with_checkpoint_dir(spark)
    chunks = filing_chunks(spark, sf_dir).select(F.col("chunk_id").alias("vec_id"), "text").checkpoint()
    model = hooks.fit_embedding(chunks, 256)
    held = plan.fenced_filter(hooks.embed(chunks, model=model), F.exists("embedding", lambda x: x != 0)).select("vec_id", "embedding")
    index = vector_index.measured(vector_index.build(held, max(2, round(chunks.count() ** 0.5)), "cosine"))
    asked = research.sub_questions(questions(spark, sf_dir))
    one = asked.groupBy("sub_question").agg(F.min("qid").alias("qid"))
    found = vector_index.retrieve_by_embedding(one, index, model, 4, 4)
    return asked.select("question_id", "step", "sub_question").join(one.withColumnRenamed("qid", "asked"), "sub_question").join(found, F.col("asked") == F.col("qid")).select("question_id", "step", "rank", "chunk_id", F.round("distance", 5).alias("distance"))


def surveyed_metrics(spark, sf_dir):
    """The seven rules for values in running text, over filings that say some of them in a sentence."""
    c = filing_chunks(spark, sf_dir)
    n = F.col("chunk_order") % 7
    said = ["Sales brought $12.5 billion in revenue.", "It made $3.4 billion of operating income.", "A net income of $7,100 was left.", "With total assets of $99.5 in all.", "And total liabilities: $42.", "Free cash flow reached $8.25.", "Earnings per share were 1.75 again."]
    text = F.concat_ws(" ", "text", F.get(F.array(*map(F.lit, said)), n.cast("int")))
    return extract.tagged_metrics(c.withColumns({"text": text, "financial_metrics": tags.financial_metrics(text)}))


def profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings as one chunk each, with what their table profile says."""
    d = filing_docs(spark, sf_dir).withColumn("_p", tags.table_profile(F.col("text")))
    d = d.withColumns({"contains_table": F.col("_p.is_table").cast("string"), "contains_financial_table": F.col("_p.is_financial_table").cast("string"), "contains_chart": F.col("text").rlike(metadata.CHART).cast("string")})
    return d.withColumns({"analysis_id": F.when(F.col("doc_id") % 7 > 0, F.concat(F.lit("s"), F.col("doc_id") % 7)), "doc_hash": F.sha2("text", 256), "source": F.concat("doc_id", F.lit(".txt"))})


def session_tables(spark, sf_dir):
    return audit.session_breakdown(profiled(spark, sf_dir))


def feature_counts(spark, sf_dir):
    return audit.feature_counts(profiled(spark, sf_dir))


def tag_counts(spark, sf_dir):
    return audit.tag_counts(filing_chunks(spark, sf_dir), "financial_metrics", 10)


def top_tags(spark, sf_dir):
    """The ten most frequent tags; ties go to the one that comes first."""
    return audit.tag_counts(filing_chunks(spark, sf_dir), "financial_metrics", 10, "chunk_order")


def broken_links(spark, sf_dir):
    """The links that break when all chunks that name liquidity are deleted."""
    c = chunk.with_neighbours(filing_chunks(spark, sf_dir))
    return audit.broken_links(files.cascade_delete(c, c.filter(F.contains("financial_metrics", F.lit("Liquidity"))), "chunk_id"))


def documents_by_session(spark, sf_dir):
    return audit.documents_by_session(filing_chunks(spark, sf_dir))


def index_chunks(spark, sf_dir):
    """Chunks of the filings that a manifest names: those of suppliers without debts of their own."""
    named = table(spark, sf_dir, "supplier").filter("s_acctbal >= 0").select(F.concat(F.lit("Supplier "), F.col("s_suppkey").cast("string"), F.lit(" Holdings Ltd")).alias("company"))
    d = filing_docs(spark, sf_dir).withColumn("source_file", F.concat("doc_id", F.lit(".txt")))
    manifest = d.join(named, "company").select("source_file", "company", F.lit("Annual Report").alias("doc_type"), "period")
    return files.index_chunks(d.select("doc_id", "source_file", "text"), manifest).withColumn("text", F.md5("text")).withColumnRenamed("text", "text_md5")


def get_chunks(spark, sf_dir):
    """The first hundred chunks of a section, with what is asked for."""
    return retrieve.get(filing_chunks(spark, sf_dir), {"section": "Balance Sheet"}, 100, ["company", "source"], "chunk_order")


def session_chunks(spark, sf_dir):
    return retrieve.session(filing_chunks(spark, sf_dir), "s5").select("chunk_id", "company")


def list_documents(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").cast("date").alias("created_at"))
    return files.list_documents(d).withColumn("created_at", F.col("created_at").cast("string"))


def collection_stats(spark, sf_dir):
    return files.collection_stats(filing_chunks(spark, sf_dir).withColumnRenamed("analysis_id", "collection"), "hashed-tokens")


def stored_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("unknown")).alias("source"), "text")
    _, chunks = files.stored_pair(d, chunk.char_chunks(d))
    return chunks.select("doc_id", "chunk_index", "metadata")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request about each supplier to one of eleven sessions, of which ten exist; some name no company."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k"))
    name = F.concat(F.lit("Supplier "), F.col("k").cast("string"), F.lit(" Holdings Ltd"))
    return s.select(F.when(F.col("k") % 13 == 0, " \t").otherwise(name).alias("company"), F.concat(F.lit("s"), (F.col("k") % 11).cast("string")).alias("collection"))


def collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_checkpoint_dir(spark)
    return filing_chunks(spark, sf_dir).select(F.col("analysis_id").alias("collection"), "chunk_id", "chunk_order", "company", "text").checkpoint()


def request_checks(spark, sf_dir):
    return files.validate_requests(requests(spark, sf_dir), collected(spark, sf_dir).select("collection").distinct())


def company_retrieval(spark, sf_dir):
    asked = requests(spark, sf_dir)
    return retrieve.retrieve_for_company(asked, collected(spark, sf_dir)).select("company", "collection", "rank", "chunk_id", F.round("score", 6).alias("score"))


def company_analysis(spark, sf_dir):
    found, _ = redflag.analyze(requests(spark, sf_dir), collected(spark, sf_dir))
    return found.select("company", "collection", "overall_risk", "total_flags", F.array_join(F.transform("flags", lambda x: x["category"]), ",").alias("categories"), "model_used")


def known_paths(spark, sf_dir):
    """Documents of a path that its collection holds, with the chunks that they would have made; the store holds the labelled ones."""
    d, known = hashed_and_stored(spark, sf_dir)
    d = d.select("doc_id", F.coalesce("source", F.lit("none")).alias("collection"), F.concat(F.col("doc_hash"), F.lit(".txt")).alias("source_file"), F.regexp_replace("text", "\n", "\n\n").alias("text"))
    held = d.join(known.select(F.concat("doc_hash", F.lit(".txt")).alias("source_file")).distinct(), "source_file", "left_semi")
    new, again = chunk.drop_known_paths(d.groupBy("collection", "source_file").agg(F.min_by("text", "doc_id").alias("text")), held)
    return new.select("collection", "source_file", F.lit(0).cast("long").alias("skipped_chunks"), F.lit("new").alias("status")).unionByName(again.select("collection", "source_file", "skipped_chunks", F.lit("duplicate").alias("status")))


def ingest_manifest(spark, sf_dir):
    """The store holds the first documents of each source; see ingest_manifest_stored for another."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.sha2("text", 256).alias("doc_hash"))
    known = d.groupBy("source").agg(F.min("doc_id").alias("doc_id")).join(d.select("doc_id", "doc_hash"), "doc_id").select("doc_hash")
    return files.ingest_manifest(d, known, chunk.char_chunks(d.select("doc_id", "text")))


def ingest_manifest_stored(spark, sf_dir):
    d, known = hashed_and_stored(spark, sf_dir)
    return files.ingest_manifest(d, known, chunk.char_chunks(d.select("doc_id", "text")))


QUERIES = {
    f.__name__: f
    for f in (
        research_topk, doc_hash_dedupe, word_windows, word_windows_all, word_windows_sql, wordsafe_windows_sql, char_windows, clean_documents, sentence_stats, searchable, filing_lines, metric_trend, metric_ranking, compare_companies,
        comparison_series, compare_peers, compare_all, filing_tags, decomposed_questions, inferred_companies, citations, research_answers, research_prompts, rule_flags, risk_rollup, severity_distribution,
        company_contexts, response_flags, response_fallback, risk_prompts, vector_topk, vector_topk_index, vector_topk_index_exact, embedding_dimensions, quality_totals, distinct_values, distinct_companies, metadata_completeness, missing_fields,
        session_breakdown, session_estimates, embedded_retrieval, surveyed_metrics, session_tables, feature_counts, tag_counts, top_tags, duplicate_hashes, broken_links, tagged_metrics, company_name, company_metrics_wide, documents_by_session, index_chunks,
        get_chunks, session_chunks, list_documents, collection_stats, stored_chunks, request_checks, company_retrieval, company_analysis, known_paths, ingest_manifest, replaced_sources, cascade_delete,
        doc_hash_dedupe_stored, ingest_manifest_stored, replaced_sources_whole,
    )
} | texts.QUERIES | reports.QUERIES

# Oracles

_F = f"filings as ({FILINGS_SQL}), docs as (select filing_id as doc_id, company, text from filings)"
_SQUASH = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


def _windows(size: int, step: int, src: str) -> str:
    """CTE w (doc_id, i, n, piece): word windows of src (doc_id, ws)."""
    return f"w as (select doc_id, i // {step} as i, cast(ceil(len(ws) / {step}.0) as int) as n, array_to_string(ws[i + 1:i + {size}], ' ') as piece from {src}, unnest(range(0, len(ws), {step})) t(i))"


def _case(rules: list[tuple[str, str]], col: str, default: str) -> str:
    whens = " ".join(f"when regexp_matches({col}, '{p.replace(chr(39), chr(39) * 2)}') then '{v.replace(chr(39), chr(39) * 2)}'" for v, p in rules)
    return f"case {whens} else '{default}' end"


def _csv(rules: list[tuple[str, str]], col: str) -> str:
    items = ", ".join(f"case when regexp_matches({col}, '{p.replace(chr(39), chr(39) * 2)}') then '{v}' end" for v, p in rules)
    return f"coalesce(array_to_string(list_transform(list_sort(list_transform(list_distinct(list_filter([{items}], lambda x: x is not null)), lambda x: {{'k': lower(x), 'v': x}})), lambda x: x.v), ','), '')"


_CHUNKS = rf"""{_F},
src as (select doc_id, company, sha256(text) as doc_hash, list_filter(string_split({_SQUASH}, ' '), lambda x: x <> '') as ws from docs),
{_windows(40, 30, "src")},
chunks as (
  select w.doc_id, company, doc_hash, i as chunk_index, n as total_chunks, piece as text, w.doc_id || '-' || i as chunk_id, w.doc_id * 1000 + i as chunk_order,
    {_case(tags.GUESSES, "lower(piece)", "General")} as section, w.doc_id || '.txt' as source, 's' || (w.doc_id % 10) as analysis_id, w.doc_id % 10000 as financial_year,
    {_case(tags.REPORT_TYPES, "lower(piece)", "Other")} as report_type, {_csv(tags.METRICS, "lower(piece)")} as financial_metrics
  from w join src using (doc_id))"""
_VALUES = rf"""{_F},
m as (select doc_id, company, unnest(regexp_extract_all(text, '{extract.STATEMENT}')) as x from docs),
vals as (
  select doc_id, company, regexp_extract(x, '{extract.STATEMENT}', 1) as metric, cast(regexp_extract(x, '{extract.STATEMENT}', 4) as int) as fy,
    cast(replace(regexp_extract(x, '{extract.STATEMENT}', 2), ',', '') as double) as amount, nullif(regexp_extract(x, '{extract.STATEMENT}', 3), '') as unit from m),
v as (select *, amount * case unit when 'thousand' then 1e3 when 'million' then 1e6 when 'billion' then 1e9 else 1.0 end as value from vals),
one as (select company, metric, fy, max(value) as value from v group by all),
wide as (
  select company, fy, max(value) filter (metric = 'Total Revenue') as revenue, max(value) filter (metric = 'Total Debt') as debt, max(value) filter (metric = 'Total Assets') as assets
  from v where fy = doc_id % 10000 group by company, fy),
dec as (select company, fy, cast(cast(round(revenue, 2) as decimal(20,2)) as varchar) as revenue, cast(cast(round(debt, 2) as decimal(20,2)) as varchar) as debt, cast(cast(round(assets, 2) as decimal(20,2)) as varchar) as assets from wide)"""
_RULES = """rules as (select unnest(['declin|drop|fell|down|reduced', 'borrow|debt|liability|leverag', 'cash flow|liquidity|working capital']) as p, unnest(['performance', 'capital_structure', 'liquidity']) as category,
  unnest(['High', 'Medium', 'Medium']) as severity, unnest(['Revenue or profitability decline', 'Rising leverage or debt burden', 'Liquidity pressure']) as title, unnest([0.82, 0.78, 0.75]::double[]) as confidence,
  unnest(['The retrieved evidence mentions a decline in financial performance.', 'The evidence references borrowings, debt, or higher liabilities.', 'The evidence mentions cash flow or liquidity concerns.']) as description,
  unnest(['Declining indicators should be treated as a material risk signal.', 'Higher leverage can increase refinancing and solvency risk.', 'Weak liquidity can impair the ability to fund operations.']) as reason,
  unnest(['Review management commentary and cash flow drivers in detail.', 'Assess debt maturity and covenant headroom.', 'Inspect operating cash flow and near-term obligations.']) as recommendation)"""
_FLAGS = rf"""{_F}, {_RULES},
hit as (select doc_id, company, category, severity, title, confidence, substring(text, 1, 240) as evidence, description, reason, recommendation from docs, rules where regexp_matches(lower(text), p)),
flags as (
  select * from hit union all
  select doc_id, company, 'general', 'Low', 'No clear red flag detected', 0.6, substring(text, 1, 240), 'The retrieved evidence did not contain explicit risk signals.', 'The offline analyzer is conservative when no clear risk indicators are present.',
    'Review the source material for additional context.' from docs where doc_id not in (select doc_id from hit))"""
_QUESTIONS = r"""q as (select distinct cast(l_suppkey as bigint) as question_id from lineitem),
sub as (select question_id, 1 as step, 'What is total revenue for Supplier ' || question_id || ' Holdings Ltd' as sub_question, 'Supplier ' || question_id || ' Holdings Ltd' as company from q
  union all select question_id, 2, 'what is total debt', null from q)"""
_TOPK = rf"""{_CHUNKS}, {_QUESTIONS},
tok as (select *, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) as t from chunks),
uq as (select distinct sub_question, company as scope, list_distinct(regexp_extract_all(lower(sub_question), '[a-z]+')) as qt from sub),
sc as (select sub_question, scope, chunk_id, chunk_order, section, company, text, source, len(list_intersect(qt, t)) / len(qt) as score from uq join tok on scope is null or scope = company),
best as (select *, row_number() over (partition by sub_question, scope order by score desc, chunk_order) as rank from sc qualify rank <= 4),
ev as (select question_id, step, rank, chunk_id, score, section, best.company, text, source from sub join best on sub.sub_question = best.sub_question and sub.company is not distinct from best.scope)"""

_STORED = "d as (select doc_id, source, text, sha256(text) as h from documents), k as (select distinct h from d where doc_id in (select doc_id from labels))"

_REQUESTS = "req as (select case when s_suppkey % 13 = 0 then ' ' || chr(9) else 'Supplier ' || s_suppkey || ' Holdings Ltd' end as company, 's' || (s_suppkey % 11) as collection from supplier)"
_BEST = """q as (select distinct company as c, collection, list_distinct(regexp_extract_all(lower(company || ' financial report risks financial statements performance'), '[a-z]+')) as qt from req),
sc as (select c as company, q.collection, chunk_id, chunk_order, text, len(list_intersect(qt, list_distinct(regexp_extract_all(lower(text), '[a-z]+')))) / len(qt) as score from q join chunks on analysis_id = q.collection),
best as (select *, row_number() over (partition by company, collection order by score desc, chunk_order) as rank from sc qualify rank <= 5)"""
_MANIFEST = """r as (select doc_id, text, case when trim(coalesce(text, '')) = '' then 'no_content' when exists (select 1 from k where k.h = d.h) then 'duplicate' else 'success' end as status from d)
select doc_id, status, case when status = 'success' then cast(ceil(length(text) / 800.0) as bigint) else 0 end as chunks, status = 'duplicate' as duplicates_skipped, case when status = 'no_content' then 'Document is empty or unreadable' else '' end as error, 0.0::double as seconds from r"""

ORACLES = {
    "rule_flags": f"with {_FLAGS} select doc_id, category, severity, title, confidence, description, reason, recommendation, md5(evidence) as evidence_md5 from flags",
    "word_windows": rf"""with src as (select doc_id, list_filter(string_split_regex({_SQUASH}, ' '), lambda x: x <> '') as ws from documents), {_windows(450, 350, "src")}
select doc_id, doc_id || '-' || i as chunk_id, i as chunk_index, n as total_chunks, case when i > 0 then doc_id || '-' || (i - 1) else '' end as previous_chunk_id,
  case when i < n - 1 then doc_id || '-' || (i + 1) else '' end as next_chunk_id, md5(piece) as text_md5,
  length(piece) + coalesce(length(lag(piece) over p) + 2, 0) + coalesce(length(lead(piece) over p) + 2, 0) as window_chars from w window p as (partition by doc_id order by i)""",
    "filing_tags": rf"""with {_F} select doc_id, {_case(tags.REPORT_TYPES, "lower(" + _SQUASH + ")", "Other")} as report_type, {_case(tags.GUESSES, "lower(text)", "General")} as section,
  {_csv(tags.METRICS, "lower(text)")} as financial_metrics, {_csv(tags.TOPICS, "lower(text)")} as semantic_tags, cast(regexp_extract(lower(text), '\bannual\s+report\s+((19|20)\d{{2}})\b', 1) as int) as financial_year from docs""",
    "compare_all": f"""with {_VALUES}, k as (select * from one where value is not null), l as (select metric, fy, arg_min(company, row(-value, company)) as leader, max(value) as leader_value from k group by metric, fy)
select o.company, metric, fy, o.value, leader, leader_value, case when o.value > leader_value then o.company when leader_value > o.value then leader else 'Equal' end as winner from one o join l using (metric, fy)""",
    "response_flags": f"""with {_FLAGS} select doc_id, category as asked, case when doc_id % 7 < 5 then category end as category, case when doc_id % 7 < 5 then severity end as severity,
  case when doc_id % 7 < 5 then confidence end as confidence, doc_id % 7 < 5 as valid from flags""",
    "response_fallback": f"""with {_FLAGS}, one as (select doc_id, min(category) as category from flags group by 1)
select doc_id, category, severity, confidence, 'model' as model_used from flags join one using (doc_id, category) where doc_id % 7 < 5
union all select doc_id, category, severity, confidence, 'offline-fallback' from flags where doc_id % 7 >= 5""",
    "risk_prompts": f"""with {_CHUNKS}, t as (select company, row_number() over (partition by company order by chunk_order) as i, text, to_json({{'company': company, 'section': section, 'source_file': source}}) as meta,
  cast(coalesce(sum(length(text) + 1) over (partition by company order by chunk_order rows between unbounded preceding and 1 preceding), 0) // 1000 as int) as part_no from chunks)
select company, part_no, md5('{research.RISK_RULES}' || chr(10) || chr(10) || 'Context:' || chr(10) || string_agg('Chunk ' || i || ': ' || text || chr(10) || 'Metadata: ' || meta, chr(10) || chr(10) order by i)) as prompt_md5 from t group by company, part_no""",
    "quality_totals": f"""with {_CHUNKS} select count(*) as chunks, count(distinct doc_hash) as documents, count(distinct analysis_id) as sessions, count(distinct company) as companies, count(distinct report_type) as report_types,
  count(distinct financial_year) as years, round(avg(len(string_split(text, ' '))), 6) as avg_chunk_words from chunks""",
    "distinct_values": f"""with {_CHUNKS} select distinct field, value from (select unnest(['company', 'report_type', 'financial_year']) as field, unnest([company, report_type, cast(financial_year as varchar)]) as value from chunks) where value <> ''""",
    "distinct_companies": f"with {_CHUNKS} select distinct company from chunks where company <> ''",
    "metadata_completeness": f"""with {_CHUNKS}, s as (select count(*) as n, count(nullif(financial_metrics, '')) as m, count(*) filter (chunk_index > 0) as p, count(*) filter (chunk_index < total_chunks - 1) as q from chunks),
f as (select n, unnest(['analysis_id', 'source', 'doc_hash', 'chunk_index', 'total_chunks', 'company_name', 'report_type', 'financial_year', 'financial_metrics', 'previous_chunk_id', 'next_chunk_id', 'page_start', 'page_end', 'page_numbers', 'section_title', 'section_type',
    'semantic_tags', 'contains_table', 'contains_financial_table', 'contains_chart']) as field, unnest([n, n, n, n, n, n, n, n, m, p, q, 0, 0, 0, 0, 0, 0, 0, 0, 0]) as h from s)
select field, n - h as missing, coalesce(h / nullif(n, 0), 0.0) as share from f""",
    "missing_fields": r"""with d as (select source, text from documents where regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') <> ''),
k as (select distinct unnest(json_keys(case when source is null then json_object('length', length(text)) else json_object('source', source, 'length', length(text)) end)) as f from d)
select f.field from (select unnest(['source', 'length', 'doc_hash', 'page_number', 'company_index']) as field) f where field not in (select f from k)""",
    "session_breakdown": f"""with {_CHUNKS}, s as (select analysis_id as session, count(*) as chunks, count(distinct doc_hash) as documents, count(distinct source) as sources, count(distinct company) as companies from chunks group by 1)
select *, row_number() over (order by session) as session_no from s""",
    "session_tables": f"""with p as ({texts.ORACLES['table_profiles']}), filing2 as ({FILINGS_SQL}), s as (select coalesce(case when filing_id % 7 > 0 then 's' || (filing_id % 7) end, 'unknown') as session, count(*) as chunks, count(distinct sha256(text)) as documents, count(distinct filing_id) as sources,
  count(distinct company) as companies, count(*) filter (is_table) as tables, count(*) filter (is_financial_table) as financial_tables from filing2 join p on p.doc_id = filing_id group by 1)
select *, row_number() over (order by session) as session_no from s""",
    "feature_counts": f"with p as ({texts.ORACLES['table_profiles']}) select count(*) filter (is_table) as tables, count(*) filter (is_financial_table) as financial_tables, 0 as charts from p",
    "tag_counts": f"with {_CHUNKS}, t as (select unnest(string_split(financial_metrics, ',')) as tag from chunks) select tag, count(*) as n from t where tag <> '' group by tag order by n desc, tag limit 10",
    "top_tags": f"""with {_CHUNKS}, t as (select chunk_order, i, string_split(financial_metrics, ',')[i] as tag from chunks, unnest(range(1, len(string_split(financial_metrics, ',')) + 1)) t(i))
select tag, count(*) as n from t where tag <> '' group by tag order by n desc, min(row(chunk_order, i)) limit 10""",
    "broken_links": f"""with {_CHUNKS}, c as (select * from chunks where not contains(financial_metrics, 'Liquidity')),
l as (select chunk_id, unnest([case when chunk_index > 0 then doc_id || '-' || (chunk_index - 1) end, case when chunk_index < total_chunks - 1 then doc_id || '-' || (chunk_index + 1) end]) as link from c)
select chunk_id, link from l where link is not null and link not in (select chunk_id from c)""",
    "documents_by_session": f"with {_CHUNKS}, t as (select analysis_id as session, count(distinct source) as n_sources, count(*) as n_chunks from chunks group by 1) select distinct analysis_id as session, source, n_sources, n_chunks from chunks join t on session = analysis_id",
    "index_chunks": rf"""with {_F}, m as (select docs.*, list_filter(string_split({_SQUASH}, ' '), lambda x: x <> '') as ws from docs join supplier on company = 'Supplier ' || s_suppkey || ' Holdings Ltd' where s_acctbal >= 0), {_windows(120, 100, "m")}
select w.doc_id || '-' || i as chunk_id, w.doc_id, i as chunk_index, n as total_chunks, company, 'Annual Report' as doc_type, {_case(tags.GUESSES, "lower(piece)", "General")} as section, w.doc_id || '.txt' as source_file, 'FY' || (w.doc_id % 10000) as period, md5(piece) as text_md5 from w join m using (doc_id)""",
    "get_chunks": f"with {_CHUNKS} select chunk_order, company, source from chunks where section = 'Balance Sheet' order by chunk_order limit 100",
    "session_chunks": f"with {_CHUNKS} select chunk_id, company from chunks where analysis_id = 's5'",
    "list_documents": "select o_orderkey as doc_id, cast(cast(o_orderdate as date) as varchar) as created_at from orders",
    "collection_stats": f"with {_CHUNKS} select analysis_id as collection, count(*) as chunks, 'hashed-tokens' as embedding_model from chunks group by 1",
    "stored_chunks": r"""select doc_id, i // 800 as chunk_index, '{"source":"' || coalesce(source, 'unknown') || '","length":' || least(1000, length(text) - i) || '}' as metadata
  from documents, unnest(range(0, length(text), 800)) t(i) where regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''""",
    "request_checks": f"""with {_CHUNKS}, {_REQUESTS} select company, collection, case when trim(company, chr(9) || ' ') = '' then 'company is blank' when collection not in (select analysis_id from chunks) then 'collection is unknown' end as reason from req""",
    "company_retrieval": f"with {_CHUNKS}, {_REQUESTS}, {_BEST} select company, collection, rank, chunk_id, round(score, 6) as score from best",
    "company_analysis": f"""with {_CHUNKS}, {_REQUESTS}, {_BEST}, {_RULES}, ctx as (select company, collection, lower(string_agg(text, chr(10) order by rank)) as low from best where trim(company, chr(9) || ' ') <> '' group by 1, 2),
h as (select company, collection, category, severity from ctx, rules where regexp_matches(low, p)),
a as (select * from h union all select company, collection, 'general', 'Low' from ctx where not exists (select 1 from h where h.company = ctx.company and h.collection = ctx.collection))
select company, collection, case when bool_or(severity = 'High') then 'High' when count(*) > 1 then 'Medium' else 'Low' end as overall_risk, count(*) as total_flags, string_agg(category, ',' order by category) as categories, 'offline-fallback' as model_used from a group by 1, 2""",
    "known_paths": rf"""with recursive {_STORED}, q as (select coalesce(source, 'none') as collection, h || '.txt' as source_file, arg_min(text, doc_id) as text, bool_or(h in (select h from k)) as held from d where h is not null group by 1, 2),
src as (select row_number() over (order by collection, source_file) as doc_id, * from q), p0 as (select doc_id, i, {texts._STRIP.format("string_split(text, chr(10))[i]")} as x from src, unnest(range(1, len(string_split(text, chr(10))) + 1)) t(i) where held),
p as (select doc_id, row_number() over (partition by doc_id order by i) as i, length(x) as n from p0 where x <> ''),
r as (select doc_id, i, n as used, 0 as chunk from p where i = 1 union all select p.doc_id, p.i, case when r.used + p.n > 1200 then p.n else r.used + p.n end, r.chunk + case when r.used + p.n > 1200 then 1 else 0 end from r join p on p.doc_id = r.doc_id and p.i = r.i + 1),
c as (select doc_id, max(chunk) + 1 as n from r group by 1)
select collection, source_file, case when held then coalesce(n, 0) else 0 end as skipped_chunks, case when held then 'duplicate' else 'new' end as status from src left join c using (doc_id)""",
    "ingest_manifest": f"""with d as (select doc_id, source, text, sha256(text) as h from documents), k as (select distinct h from d join (select source as s, min(doc_id) as m from d group by 1) f on d.doc_id = f.m), {_MANIFEST}""",
    "ingest_manifest_stored": f"with {_STORED}, {_MANIFEST}",
    "research_topk": f"with {_TOPK} select question_id, step, rank, chunk_id, round(score, 6) as score, section from ev",
    "citations": f"""with {_TOPK}, one as (select * from ev qualify row_number() over (partition by question_id, chunk_id order by step, rank) = 1)
select question_id, row_number() over (partition by question_id order by step, rank) as citation_no,
  '[' || company || ' | Annual Report | ' || section || ' | ' || source || ' | chunk ' || chunk_id || ']' as citation,
  md5(case when length(text) > 220 then substring(text, 1, 220) || '{tx.ELLIPSIS}' else text end) as snippet_md5 from one""",
    "word_windows_all": rf"""with src as (select doc_id, list_filter(string_split_regex({_SQUASH}, ' '), lambda x: x <> '') as ws from documents), {_windows(450, 350, "src")}
select doc_id, doc_id || '-' || i as chunk_id, i as chunk_index, n as total_chunks, case when i > 0 then doc_id || '-' || (i - 1) else '' end as previous_chunk_id,
  case when i < n - 1 then doc_id || '-' || (i + 1) else '' end as next_chunk_id, md5(piece) as text_md5,
  length(piece) + coalesce(length(lag(piece) over p) + 2, 0) + coalesce(length(lead(piece) over p) + 2, 0) as window_chars from w window p as (partition by doc_id order by i)""",
    "char_windows": "select doc_id, i // 800 as chunk_index, md5(substring(text, i + 1, 1000)) as text_md5 from documents, unnest(range(0, length(text), 800)) t(i)",
    "clean_documents": rf"""select doc_id, md5({_SQUASH}) as squashed_md5,
  length(trim(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'))) as clean_chars from documents""",
    "sentence_stats": r"""select doc_id, length(text) as characters, len(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> '')) as words,
  len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')) as sentences,
  len(list_filter(string_split_regex(text, '\n\s*\n'), lambda x: trim(x) <> '')) as paragraphs from documents""",
    "searchable": r"""with p as (select doc_id, i, string_split(text, chr(10))[i] as line from documents, unnest(range(1, least(5, len(string_split(text, chr(10)))) + 1)) t(i))
select doc_id from p group by doc_id having count(*) filter (len(list_filter(string_split(trim(regexp_replace(line, '\s+', ' ', 'g')), ' '), lambda x: x <> '')) >= 5) >= greatest(1, count(*) // 2)""",
    "filing_lines": f"with {_VALUES} select doc_id, metric, fy, amount, unit, value from v",
    "metric_trend": f"""with {_VALUES}, t as (select *, lag(value) over (partition by company, metric order by fy) as previous from one)
select company, metric, fy, value, previous, round((value - previous) / nullif(abs(previous), 0), 6) as change,
  case when previous is null then 'first' when value > previous then 'rising' when value < previous then 'falling' else 'flat' end as direction from t""",
    "metric_ranking": f"""with {_VALUES}, r as (select metric, fy, count(*) as companies, max(row(value, company)) as b, min(row(value, company)) as w from one where value is not null group by metric, fy)
select metric, fy, companies, b[2] as best, b[1] as best_value, w[2] as worst, w[1] as worst_value from r""",
    "compare_companies": f"""with {_VALUES}, k as (select company, metric || ' FY' || fy as metric, value from one)
select a.metric, a.value as value_1, b.value as value_2, case when a.value > b.value then 'Company 1' when b.value > a.value then 'Company 2' else 'Equal' end as winner
from k a join k b using (metric) where a.company = 'Supplier 1 Holdings Ltd' and b.company = 'Supplier 2 Holdings Ltd'""",
    "comparison_series": f"""with {_VALUES}, k as (select company, metric || ' FY' || fy as metric, value from one)
select metric, case company when 'Supplier 1 Holdings Ltd' then 'Company 1' else 'Company 2' end as series, value from k
where company in ('Supplier 1 Holdings Ltd', 'Supplier 2 Holdings Ltd') and metric in (select metric from k where company = 'Supplier 1 Holdings Ltd' intersect select metric from k where company = 'Supplier 2 Holdings Ltd')""",
    "compare_peers": f"""with {_VALUES} select b.company, metric, fy, a.value as own, b.value, case when a.value > b.value then a.company when b.value > a.value then b.company else 'Equal' end as winner
from one a join one b using (metric, fy) where a.company = 'Supplier 1 Holdings Ltd' and b.company <> a.company""",
    "research_prompts": f"""with {_TOPK}, qq as (select question_id, 'What is total revenue for Supplier ' || question_id || ' Holdings Ltd, and what is total debt?' as question from q),
l as (select question_id, step, 0 as rank, 'Sub-question: ' || sub_question as line from sub union all
  select question_id, step, rank, '- Evidence [' || company || ' | Annual Report | ' || section || ' | ' || source || ' | chunk ' || chunk_id || ']: ' || case when length(text) > 220 then substring(text, 1, 220) || '{tx.ELLIPSIS}' else text end from ev)
select question_id, md5('Answer from the evidence alone, step by step, and cite the bracketed tags.' || chr(10) || chr(10) || 'Question: ' || any_value(question) || chr(10) || chr(10) || 'Evidence:' || chr(10) || string_agg(line, chr(10) order by step, rank)) as prompt_md5 from l join qq using (question_id) group by 1""",
    "research_answers": f"""with {_TOPK}, qq as (select question_id, 'What is total revenue for Supplier ' || question_id || ' Holdings Ltd, and what is total debt?' as question from q),
n as (select question_id, step, count(*) as n, string_agg('    - ' || case when length(text) > 220 then substring(text, 1, 220) || '{tx.ELLIPSIS}' else text end || chr(10) || '      Source: [' || company || ' | Annual Report | ' || section || ' | ' || source || ' | chunk ' || chunk_id || ']', chr(10) order by rank) as body from ev group by 1, 2),
s as (select question_id, step, 'Step ' || step || ': ' || sub_question || chr(10) || coalesce('  Evidence found in ' || n || ' source passage(s):' || chr(10) || body, '  No indexed documents contain evidence for this.') as block from sub left join n using (question_id, step))
select question_id, any_value(question) as question, 'Research question: ' || any_value(question) || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) order by step) as answer from s join qq using (question_id) group by 1""",
    "decomposed_questions": f"with {_QUESTIONS} select question_id, step, sub_question from sub",
    "inferred_companies": f"with {_QUESTIONS} select question_id, step, company from sub",
    "risk_rollup": f"with {_FLAGS} select company, case when bool_or(severity = 'High') then 'High' when count(*) > 1 then 'Medium' else 'Low' end as overall_risk, count(*) as total_flags from flags group by company",
    "severity_distribution": f"with {_FLAGS} select company, count(*) filter (severity = 'Low') as low, count(*) filter (severity = 'Medium') as medium, count(*) filter (severity = 'High') as high from flags group by company",
    "company_contexts": f"""with {_CHUNKS}, p as (select company, chunk_order, text, cast(coalesce(sum(length(text) + 1) over (partition by company order by chunk_order rows between unbounded preceding and 1 preceding), 0) // 1000 as int) as part_no from chunks where text <> '')
select company, part_no, length(string_agg(text, chr(10) order by chunk_order)) as chars, md5(string_agg(text, chr(10) order by chunk_order)) as text_md5 from p group by 1, 2""",
    "vector_topk": """with d as (select a.vec_id as query_id, b.vec_id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (cast(x[1] as double) - x[2]) * (cast(x[1] as double) - x[2]))) as d
  from embeddings a, embeddings b where a.vec_id % 50 = 0)
select query_id, vec_id, row_number() over (partition by query_id order by d, vec_id) as rank, round(d, 6) as distance from d qualify rank <= 5""",
    "embedding_dimensions": "select len(embedding) as dimension, count(*) as n from embeddings where embedding is not null group by 1",
    "duplicate_hashes": "select sha256(text) as doc_hash, count(*) as n from documents group by 1 having count(*) > 1",
    "company_name": f"with {_F} select doc_id, company, 0.73 as score from docs",
    "tagged_metrics": rf"""with {_CHUNKS}, r as (select unnest(['Revenue', 'Debt', 'EPS']) as metric, unnest(['(?i)total revenue: \$([\d.,]+)', '(?i)total debt: \$([\d.,]+)', '(?i)earnings per share.*?([\d.]+)']) as p),
v as (select company, metric, chunk_order, case when contains(lower(financial_metrics), lower(metric)) and regexp_matches(text, p) then trim(regexp_extract(text, p, 1)) end as v from chunks, r)
select company, metric, coalesce(arg_min(v, chunk_order) filter (v is not null), 'Not Found') as value from v group by 1, 2""",
    "surveyed_metrics": rf"""with {_CHUNKS},
said as (select company, chunk_order, text || ' ' || ['Sales brought $12.5 billion in revenue.', 'It made $3.4 billion of operating income.', 'A net income of $7,100 was left.', 'With total assets of $99.5 in all.', 'And total liabilities: $42.', 'Free cash flow reached $8.25.', 'Earnings per share were 1.75 again.'][chunk_order % 7 + 1] as text from chunks),
tagged as (select *, lower({_csv(tags.METRICS, "lower(text)")}) as t from said),
r as (select unnest(['Revenue', 'Operating Income', 'Net Income', 'Assets', 'Liabilities', 'Cash Flow', 'EPS']) as metric, unnest(['(?i)\$([\d.,]+)\s*billion.*?revenue', '(?i)\$([\d.,]+)\s*billion.*?operating income', '(?i)net income.*?\$([\d.,]+)',
  '(?i)total assets.*?\$([\d.,]+)', '(?i)total liabilities.*?\$([\d.,]+)', '(?i)cash flow.*?\$([\d.,]+)', '(?i)earnings per share.*?([\d.]+)']) as p),
v as (select company, metric, chunk_order, case when contains(t, lower(metric)) and regexp_matches(text, p) then trim(regexp_extract(text, p, 1)) end as v from tagged, r)
select company, metric, coalesce(arg_min(v, chunk_order) filter (v is not null), 'Not Found') as value from v group by 1, 2""",
    "session_estimates": f"with {_CHUNKS} select analysis_id as session, count(*) as chunks, count(distinct doc_hash) as documents, count(distinct source) as sources, count(distinct company) as companies from chunks group by 1",
    "company_metrics_wide": f"""with {_VALUES}, l as (select company, metric, max_by(value, fy) as value from one group by all)
select company, max(value) filter (metric = 'Total Revenue') as total_revenue, max(value) filter (metric = 'Total Debt') as total_debt, max(value) filter (metric = 'Total Assets') as total_assets from l group by company""",
    "cascade_delete": "select l_orderkey, l_linenumber from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')",
    "doc_hash_dedupe_stored": f"with {_STORED} select doc_id, source, h as doc_hash from d where not exists (select 1 from k where k.h = d.h) qualify row_number() over (partition by h order by source, doc_id) = 1",
    "replaced_sources_whole": """with f as (select min(source) as s from documents)
select source, doc_id from documents where source is distinct from (select s from f) union all select source, -doc_id - 1 from documents where source = (select s from f)""",
} | texts.ORACLES | reports.ORACLES
ORACLES["vector_topk_index_exact"] = ORACLES["vector_topk"]
ORACLES["doc_hash_dedupe"] = ORACLES["doc_hash_dedupe_stored"]
ORACLES["replaced_sources"] = ORACLES["replaced_sources_whole"]
ORACLES["word_windows_sql"] = f"select doc_id, chunk_index, text_md5 from ({ORACLES['word_windows']})"
ORACLES["wordsafe_windows_sql"] = ORACLES["wordsafe_windows"]
