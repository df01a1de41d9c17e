"""Quality rules: counts of every whole text and a hashed n-gram likelihood ratio.

Word unigrams and bigrams hash into BUCKETS. One scan counts them over the raw corpus (all
documents) and over the trusted target (documents labelled good); the second scan adds up each
document's log ratios, divides by their number and keeps the document at THRESHOLD or above.

Only DataFrame operations. Nothing but the counts of the buckets is shuffled; texts stay where they
are read. The trusted target is a bounded sample: the TRUSTED labelled ids that come first by hash.
The raw corpus is counted whole.

Defined cases: a null or empty text has no words, all counts 0, score 0 and fails the base rule; a
label row without id or quality is left out; repeated label rows count once; without trusted
documents every ratio is 0 and only the base rule decides; repeated documents are judged each by
itself; a document column with the name of a result column is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argosy.llm.common import SPACE, WORD, kept, row, unpacked

BUCKETS = 8192
TRUSTED = 20_000
SMOOTHING = 0.5
#: Counts per bucket, dealt like the raw corpus, that the target begins with: few trusted documents move no ratio far.
PRIOR = 20.0
THRESHOLD = -0.04
WINDOW = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def _pair(x: str, gap: int) -> Column:
    """Hashes of each element of x with the one ``gap`` further on."""
    n = F.greatest(F.size(x) - gap, F.lit(0))
    return F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, F.lit(gap + 1), n), lambda a, b: F.xxhash64(a, b))


def grams(df: DataFrame, text: str) -> DataFrame:
    """Add _h1 and _h2, the hashes of the words and of neighbouring words."""
    return df.withColumn("_h1", F.transform(_words(F.col(text)), lambda w: F.xxhash64(w))).withColumn("_h2", _pair("_h1", 1))


def counts(df: DataFrame, text: str) -> DataFrame:
    """Add the base counts to a frame that grams() made."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(WORD))
    # equal windows are neighbours once sorted by hash; the words that they cover are counted by the gaps between their starts
    windows = F.array_sort(F.transform("_h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    is_twin = lambda x, i: (x["h"] == F.get("_sorted", i - 1)["h"]) | (x["h"] == F.get("_sorted", i + 1)["h"])
    twins = F.transform(F.filter("_sorted", lambda x, i: F.coalesce(is_twin(x, i), F.lit(False))), lambda x: x["i"])
    after = F.concat(F.slice("_at", F.lit(2), F.size("_at")), F.array(F.lit(2**31 - 1)))
    gaps = F.zip_with("_at", after, lambda a, b: F.least(F.lit(WINDOW), b - a))
    return (
        df.withColumn("_h4", _pair("_h2", 2))
        .withColumn("_h8", _pair("_h4", 4))
        .withColumn("_sorted", F.when(F.size(F.array_distinct("_h8")) < F.size("_h8"), windows))
        .withColumn("_at", F.array_sort(twins))
        .withColumn("_lines", lines)
        .withColumns(
            {
                "n_words": F.size("_h1").cast("long"),
                "word_chars": F.length(F.translate(body, " \t\n\x0b\f\r", "")).cast("long"),
                "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
                "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
                "n_repeat_words": F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long"),
            }
        )
        .drop("_h4", "_h8", "_sorted", "_at", "_lines")
    )


def trusted_ids(labels: DataFrame, bound: int = TRUSTED, doc_id: str = "doc_id") -> DataFrame:
    """At most ``bound`` ids of documents that are labelled good and not toxic, the first by hash."""
    good = labels.filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col(doc_id).isNotNull())
    ids = good.select(F.col(doc_id).alias("_good")).distinct()
    return ids.orderBy(F.xxhash64("_good"), "_good").limit(bound)


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, doc_id: str = "doc_id", text: str = "text") -> list[float]:
    """log(target share / raw share) of each bucket; ``buckets`` rows come to the driver."""
    d = grams(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")), "_t")
    marked = d.join(F.broadcast(trusted_ids(labels)), F.col("_id") == F.col("_good"), "left").select(F.col("_good").isNotNull().alias("good"), F.explode(F.concat("_h1", "_h2")).alias("h"))
    found = marked.groupBy(F.pmod("h", F.lit(buckets)).alias("b")).agg(F.count("*").alias("raw"), F.count_if("good").alias("target")).collect()
    raw, target = [SMOOTHING] * buckets, [0.0] * buckets
    for r in found:
        raw[r.b] += r.raw
        target[r.b] = r.target
    whole, prior = sum(raw), PRIOR * buckets
    seen = sum(target)
    return [math.log((t + prior * r / whole) / (seen + prior)) - math.log(r / whole) for t, r in zip(target, raw, strict=True)]


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Documents with the base counts, base_failed, score (mean log ratio) and kept.

    keep: the document columns that go on (all if None).
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    on = kept(docs, keep, made)
    ratios = log_ratios(docs, labels, doc_id=doc_id, text=text)
    table = F.expr(f"cast(split('{','.join(map(repr, ratios))}', ',') as array<double>)")
    d = counts(grams(docs.select(row(on).alias("_row"), F.col(text).alias("_t")), "_t"), "_t")
    total = F.aggregate(F.concat("_h1", "_h2"), F.lit(0.0), lambda a, h: a + F.get(table, F.pmod(h, F.lit(len(ratios))).cast("int")))
    failed = (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words"))
    return (
        d.withColumn("score", F.coalesce(total / F.nullif(F.size("_h1") + F.size("_h2"), F.lit(0)), F.lit(0.0)))
        .withColumn("base_failed", failed)
        # a caller's filter on kept stays above this column; pushed below it, it would compute the counts at each mention again
        .withColumn("_fence", F.monotonically_increasing_id())
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold) & (F.col("_fence") >= 0))
        .select(*unpacked(on), *made)
    )
