"""Answers with citations for a table of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argosy.functions import text as tx
from argosy.operators import retrieve as rt
from argosy.operators.redflag import CONTEXT, part_no
from argosy.session import with_checkpoint_dir

NO_EVIDENCE = "No indexed documents contain evidence for this."


def sub_questions(questions: DataFrame) -> DataFrame:
    """(question_id, step, sub_question, qid) from (question_id, question); step from 1."""
    parts = questions.select("question_id", F.posexplode(tx.decompose(F.col("question"))).alias("step", "sub_question"))
    return parts.withColumn("step", F.col("step") + 1).withColumn("qid", F.concat_ws("/", "question_id", "step"))


def evidence(questions: DataFrame, chunks: DataFrame, k: int = 4) -> DataFrame:
    """One row for each sub-question and cited chunk. Equal sub-questions are looked at and retrieved once."""
    with_checkpoint_dir(chunks.sparkSession)
    subs = sub_questions(questions)
    one = subs.groupBy("sub_question").agg(F.min("qid").alias("qid"))
    one = rt.infer_company(one, chunks.select("company")).checkpoint()
    found = rt.retrieve(one, chunks, k).withColumnRenamed("qid", "asked")
    of = subs.drop("qid").join(one.select("sub_question", F.col("company").alias("scope"), F.col("qid").alias("asked")), "sub_question").select("question_id", "step", "sub_question", "scope", "asked")
    cited = of.join(found, "asked", "left").drop("asked")
    default = lambda c: F.coalesce(F.col(c), F.lit("unknown")) if c in cited.columns else F.lit("unknown")
    cited = cited.withColumns({c: default(c) for c in ("company", "doc_type", "section", "source_file")}).withColumn("snippet", tx.snippet(F.col("text")))
    tag = F.concat(F.lit("["), F.concat_ws(" | ", "company", "doc_type", "section", "source_file", F.concat(F.lit("chunk "), "chunk_id")), F.lit("]"))
    return cited.withColumn("citation", F.when(F.col("chunk_id").isNotNull(), tag))


def all_citations(cited: DataFrame) -> DataFrame:
    """The distinct citations of each question, where first cited, in order."""
    w = Window.partitionBy("question_id", "company", "doc_type", "section", "chunk_id").orderBy("step", "rank")
    first = cited.filter("chunk_id IS NOT NULL").withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    order = Window.partitionBy("question_id").orderBy("step", "rank")
    return first.withColumn("citation_no", F.row_number().over(order)).drop("_n")


def _steps(cited: DataFrame) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.when(F.col("chunk_id").isNotNull(), F.struct("rank", "snippet", "citation"))))
    return cited.groupBy("question_id", "step", "sub_question").agg(lines.alias("found"))


def _whole(steps: DataFrame, block, questions: DataFrame) -> DataFrame:
    each = steps.withColumn("block", block)
    ordered = F.array_sort(F.collect_list(F.struct("step", "block")))
    return questions.select("question_id", "question").join(each.groupBy("question_id").agg(ordered.alias("steps")), "question_id")


def answers(cited: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, question, answer): the evidence of each step, quoted with its sources."""
    quoted = F.flatten(F.transform("found", lambda x: F.array(F.concat(F.lit("    - "), x["snippet"]), F.concat(F.lit("      Source: "), x["citation"]))))
    head = F.array(F.concat(F.lit("Step "), F.col("step"), F.lit(": "), F.col("sub_question")))
    body = F.when(F.size("found") > 0, F.concat(F.array(F.concat(F.lit("  Evidence found in "), F.size("found"), F.lit(" source passage(s):"))), quoted)).otherwise(F.array(F.lit(f"  {NO_EVIDENCE}")))
    whole = _whole(_steps(cited), F.array_join(F.concat(head, body), "\n"), questions)
    text = F.concat(F.lit("Research question: "), "question", F.lit("\n\n"), F.array_join(F.transform("steps", lambda s: s["block"]), "\n\n"))
    return whole.select("question_id", "question", text.alias("answer"))


def prompts(cited: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, prompt) for a language model that a caller runs: the question and its tagged evidence."""
    lines = F.concat(F.array(F.concat(F.lit("Sub-question: "), F.col("sub_question"))), F.transform("found", lambda x: F.concat(F.lit("- Evidence "), x["citation"], F.lit(": "), x["snippet"])))
    whole = _whole(_steps(cited), F.array_join(lines, "\n"), questions)
    text = F.concat(F.lit("Answer from the evidence alone, step by step, and cite the bracketed tags.\n\nQuestion: "), "question", F.lit("\n\nEvidence:\n"), F.array_join(F.transform("steps", lambda s: s["block"]), "\n"))
    return whole.select("question_id", text.alias("prompt"))


RISK_RULES = """You are a financial risk analyst. Find red flags in the passages below.
Use nothing but the passages, invent no figures, quote evidence for every finding and name its page where it is known.
Answer in JSON alone: overall_risk (Low, Medium, High or Critical), total_flags and flags. A flag has category (Debt, Liquidity, Profitability, Revenue, Cash Flow, Auditor, Legal, Accounting or Corporate Governance), severity, title, description, reason, evidence, page, recommendation and confidence (0 to 1).
Without evidence answer {"overall_risk":"Low","total_flags":0,"flags":[]}."""


def risk_prompts(chunks: DataFrame, by: str, metadata: tuple[str, ...] = ("company", "section", "source_file"), budget: int = CONTEXT) -> DataFrame:
    """(by, part_no, prompt) for a language model that a caller runs: the rules, then the chunks of each ``by`` in order of rank,
    each with its number and its metadata as JSON. More chunks than ``budget`` characters go on in further prompts."""
    here = [c for c in metadata if c in chunks.columns]
    place = Window.partitionBy(by).orderBy("rank")
    rows = chunks.withColumns({"_no": F.row_number().over(place), "_part": part_no(by, "rank", F.length(F.coalesce("text", F.lit(""))) + 1, budget)})
    line = F.concat(F.lit("Chunk "), F.col("_no").cast("string"), F.lit(": "), F.coalesce("text", F.lit("")), F.lit("\nMetadata: "), F.to_json(F.struct(*here)))
    held = rows.groupBy(by, "_part").agg(F.array_sort(F.collect_list(F.struct("_no", line.alias("line")))).alias("h"))
    return held.select(by, F.col("_part").alias("part_no"), F.concat(F.lit(f"{RISK_RULES}\n\nContext:\n"), F.array_join(F.transform("h", lambda x: x["line"]), "\n\n")).alias("prompt"))
