"""Red flags by rules, their roll-ups, and flags out of model responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argosy.functions import text as tx
from argosy.operators import retrieve
from argosy.sources import files

LEVELS = ("Low", "Medium", "High")
EVIDENCE = 240
FALLBACK_MODEL = "offline-fallback"
# Pattern (stems, so no word boundaries), category, severity, title, confidence, description, reason, recommendation.
RULES = [
    (
        r"(declin|drop|fell|down|reduced)", "performance", "High", "Revenue or profitability decline", 0.82,
        "The retrieved evidence mentions a decline in financial performance.",
        "Declining indicators should be treated as a material risk signal.",
        "Review management commentary and cash flow drivers in detail.",
    ),
    (
        r"(borrow|debt|liability|leverag)", "capital_structure", "Medium", "Rising leverage or debt burden", 0.78,
        "The evidence references borrowings, debt, or higher liabilities.",
        "Higher leverage can increase refinancing and solvency risk.",
        "Assess debt maturity and covenant headroom.",
    ),
    (
        r"(cash flow|liquidity|working capital)", "liquidity", "Medium", "Liquidity pressure", 0.75,
        "The evidence mentions cash flow or liquidity concerns.",
        "Weak liquidity can impair the ability to fund operations.",
        "Inspect operating cash flow and near-term obligations.",
    ),
]
CLEAR = (
    "general", "Low", "No clear red flag detected", 0.6,
    "The retrieved evidence did not contain explicit risk signals.",
    "The offline analyzer is conservative when no clear risk indicators are present.",
    "Review the source material for additional context.",
)
# Risk categories of single passages by the words that show them.
PASSAGES = [
    ("Debt", r"\b(debt|borrowings?|leverage)\b"),
    ("Liquidity", r"\b(liquidity|working capital)\b"),
    ("Profitability", r"\b(loss|margins?)\b"),
    ("Revenue", r"\brevenue (fell|declined|dropped)\b"),
    ("Cash Flow", r"\bcash flow\b"),
    ("Auditor", r"\b(qualified opinion|going concern|material weakness)\b"),
    ("Legal", r"\b(litigation|lawsuit|legal proceedings)\b"),
    ("Accounting", r"\b(restatement|impairment)\b"),
    ("Corporate Governance", r"\b(governance|related party)\b"),
]
#: Characters of a part of a context, and of a prompt.
CONTEXT = 16_000
FLAG = "category STRING, severity STRING, title STRING, description STRING, reason STRING, evidence STRING, page INT, recommendation STRING, confidence DOUBLE"


def context_text(chunks: DataFrame, by: str, order: str) -> DataFrame:
    """(by, text): the non-empty chunks of each ``by`` joined by line feeds in order."""
    held = F.array_sort(F.collect_list(F.when(F.coalesce("text", F.lit("")) != "", F.struct(F.col(order).alias("o"), F.col("text").alias("t")))))
    return chunks.groupBy(by).agg(held.alias("h")).select(by, F.array_join(F.transform("h", lambda x: x["t"]), "\n").alias("text"))


def part_no(by: str, order: str, chars: Column, budget: int) -> Column:
    """The part, from 0, of a row among the rows of ``by`` in order, when each part takes on rows until ``budget`` characters
    are reached: no part is longer than the budget and one row."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.floor(F.coalesce(F.sum(chars).over(before), F.lit(0)) / budget).cast("int")


def context_parts(chunks: DataFrame, by: str, order: str, budget: int = CONTEXT) -> DataFrame:
    """(by, part_no, text): context_text in rows of bounded length that follow one another, nothing left out."""
    filled = chunks.filter(F.coalesce("text", F.lit("")) != "").withColumn("_part", part_no(by, order, F.length("text") + 1, budget))
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t"))))
    return filled.groupBy(by, "_part").agg(held.alias("h")).select(by, F.col("_part").alias("part_no"), F.array_join(F.transform("h", lambda x: x["t"]), "\n").alias("text"))


def rule_flags(contexts: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    """One row for each rule that a context shows, or one that none does, with all fields of a flag; page is null."""
    low = F.lower(F.coalesce("text", F.lit("")))
    names = ("category", "severity", "title", "confidence", "description", "reason", "recommendation")
    flag = lambda values: F.struct(*(F.lit(v).alias(n) for n, v in zip(names, values, strict=True)), F.lit(None).cast("int").alias("page"))
    found = F.array_compact(F.array(*(F.when(low.rlike(p), flag(rest)) for p, *rest in rules)))
    shown = F.when(F.size(found) > 0, found).otherwise(F.array(flag(CLEAR)))
    keep = [c for c in contexts.columns if c != "text"]
    return contexts.select(*keep, F.substring("text", 1, EVIDENCE).alias("evidence"), F.inline(shown))


def overall(severity: Column) -> Column:
    """High if any flag is; else Medium if there are more than one; else Low. An aggregate."""
    return F.when(F.max((severity == "High").cast("int")) == 1, "High").when(F.count("*") > 1, "Medium").otherwise("Low")


def risk_rollup(flags: DataFrame, by: str) -> DataFrame:
    """(by, overall_risk, total_flags)."""
    return flags.groupBy(by).agg(overall(F.col("severity")).alias("overall_risk"), F.count("*").alias("total_flags"))


def severity_distribution(flags: DataFrame, by: str) -> DataFrame:
    """(by, low, medium, high): other levels don't count."""
    level = F.initcap("severity")
    return flags.groupBy(by).agg(*(F.count_if(level == x).alias(x.lower()) for x in LEVELS))


def passage_risks(chunks: DataFrame, rules: list[tuple[str, str]] = PASSAGES) -> DataFrame:
    """One row for each rule and sentence that shows it; the other columns of the chunk go along."""
    keep = [c for c in chunks.columns if c != "text"]
    each = chunks.select(*keep, F.posexplode(F.split("text", r"(?<=[.!?])\s+|\n+")).alias("sentence_no", "evidence")).filter("trim(evidence) != ''")
    low = F.lower("evidence")
    return each.select("*", F.explode(F.array_compact(F.array(*(F.when(low.rlike(p), name) for name, p in rules)))).alias("category"))


def balanced(c: Column, opens: str, closes: str) -> Column:
    """The text from the first opening sign to the one that closes it; null if there is none. Folded over the signs alone."""
    begin = F.locate(opens, c)
    rest = F.substr(c, begin)
    pieces = F.split(rest, rf"(?=[\{opens}\{closes}])")

    def step(acc: Column, piece: Column) -> Column:
        up, down = F.startswith(piece, F.lit(opens)), F.startswith(piece, F.lit(closes))
        depth = acc["depth"] + up.cast("int") - down.cast("int")
        end = F.when(acc["end"] == 0, F.when(down & (depth == 0), acc["at"] + 1).otherwise(0)).otherwise(acc["end"])
        return F.struct(depth.alias("depth"), (acc["at"] + F.length(piece)).alias("at"), end.alias("end"))

    end = F.aggregate(pieces, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end")), step, lambda acc: acc["end"])
    return F.when((begin > 0) & (end > 0), F.left(rest, end))


def json_of(c: Column) -> Column:
    """The JSON in a model's response: all of it, else a fenced block, else the first balanced object, else the first balanced
    array; null if none of them is JSON."""
    whole = tx.strip(c)
    fenced = tx.strip(F.regexp_extract(whole, r"(?is)```(?:json)?\s*(.*?)\s*```", 1))
    ok = lambda x: F.when(F.try_parse_json(x).isNotNull() & (x != ""), x)
    return F.coalesce(ok(whole), ok(fenced), ok(balanced(whole, "{", "}")), ok(balanced(whole, "[", "]")))


REQUIRED = ("category", "severity", "title", "description", "reason", "evidence", "recommendation", "confidence")


def flags_of_responses(responses: DataFrame, text: str = "response", required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """(..., flag columns, valid): flags out of model output; see json_of. An object holds them as flags, an array is them.

    A response without JSON or without flags gives one row of nulls with valid false; a flag is valid if no required field
    is missing.
    """
    each = f"ARRAY<STRUCT<{FLAG.replace(' ', ': ').replace(',: ', ', ')}>>"
    keep = [x for x in responses.columns if x != text]
    rows = responses.select(*keep, json_of(F.col(text)).alias("_j"))
    listed = F.startswith("_j", F.lit("["))
    found = F.when(listed, F.from_json("_j", each)).otherwise(F.from_json("_j", f"flags {each}")["flags"])
    flat = rows.select(*keep, F.explode_outer(found).alias("f"))
    valid = F.lit(True)
    for name in required:
        valid = valid & F.col(f"f.{name}").isNotNull()
    return flat.select(*keep, "f.*", F.coalesce(valid, F.lit(False)).alias("valid"))


def flags_or_rules(responses: DataFrame, contexts: DataFrame, key: str) -> DataFrame:
    """The flags of responses (key, response), with model_used; those of the rules over contexts (key, text) where a response
    has no JSON."""
    read = responses.withColumn("_ok", json_of(F.col("response")).isNotNull())
    fields = [key, "category", "severity", "title", "description", "reason", "evidence", "page", "recommendation", "confidence", "model_used"]
    of_model = flags_of_responses(read.filter("_ok").select(key, "response")).filter("valid").withColumn("model_used", F.lit("model"))
    of_rules = rule_flags(contexts.join(read.filter("_ok").select(key), key, "left_anti").select(key, "text")).withColumn("model_used", F.lit(FALLBACK_MODEL))
    return of_model.select(*fields).unionByName(of_rules.select(*fields))


def analyze(requests: DataFrame, chunks: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(responses, refused) for requests (company, collection) over chunks (collection, chunk_id, chunk_order, text, company).

    A response: company, collection, overall_risk, total_flags, flags, model_used, by the rules over the k best chunks of its
    collection. A blank or unknown request and one without chunks are refused with a reason.
    """
    checked = files.validate_requests(requests.distinct(), chunks.select("collection").distinct())
    found = retrieve.retrieve_for_company(checked.filter("reason IS NULL").select("company", "collection"), chunks, k)
    context = context_text(found.withColumn("key", F.struct("company", "collection")), "key", "rank")
    flags = rule_flags(context)
    one = F.struct("category", "severity", "title", "description", "reason", "evidence", "page", "recommendation", "confidence")
    rolled = flags.groupBy("key").agg(overall(F.col("severity")).alias("overall_risk"), F.count("*").alias("total_flags"), F.array_sort(F.collect_list(one)).alias("flags"))
    return rolled.select("key.company", "key.collection", "overall_risk", "total_flags", "flags", F.lit(FALLBACK_MODEL).alias("model_used")), checked.filter("reason IS NOT NULL")
