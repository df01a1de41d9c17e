"""Mixing sources to target weights by entropy balancing.

Every document gets a rate. The rates stay as near as possible (in relative entropy) to 1 while each
source's expected words meet its target and no rate exceeds the cap; the solution tilts rates
exponentially, rate = min(cap, exp(lambda_source * words)). The dual splits by source, so Newton
steps for all sources run side by side over a histogram of (source, size). Rates are then rounded
into whole copies so that a source's words miss its target by little more than its smallest gap.

Only DataFrame operations: one scan builds the histogram, one shuffle of the documents deals the
copies. A class of documents of one source and size is dealt over cells whose number grows with the
table, so that a hot one is sorted by many tasks.

Defined cases: a null text has size 0 and is taken as often as its rate of 1 says (its words are 0);
a null source is a source of its own and comes last; repeated rows are separate documents; an empty
table gives no rows; a document column with the name of a result column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argosy.llm.common import WORD, kept, row, unpacked
from argosy.session import with_checkpoint_dir

WEIGHTS = (5, 2, 1)
CAP = 3
STEPS = 16
REPAIRS = 4
#: A class of documents of one source and size is dealt over 64 cells, and over more once all rows are more than 64 times this.
CELL_ROWS = 1_000_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Add target to (key, source, source_size): shares of the total by weight, filled up to cap times each size."""
    # these windows have no partition, as targets depend on all sources: a row each of the table of sources, not of documents
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(in_order) - 1) % len(weights) + 1).cast("double")
    room = F.lit(cap) * F.col("source_size").cast("double")
    by_ratio = Window.orderBy("ratio", "key")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        sources.withColumn("w", w)
        .withColumn("room", room)
        .withColumn("ratio", F.col("room") / F.col("w"))
        .withColumn("left", F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("room").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole))
        .withColumn("target", F.least("room", F.coalesce(F.col("level") * F.col("w"), F.col("room"))))
        .drop("w", "room", "ratio", "left", "level")
    )


def balance(hist: DataFrame, cap: int = CAP, steps: int = STEPS) -> DataFrame:
    """Add rate to (key, n, c, source_size, target) by safeguarded Newton steps on each source's dual."""
    # sums go over a fixed order, so that a rerun adds the same numbers in the same order
    w = Window.partitionBy("key").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n, c, t = F.col("n").cast("double"), F.col("c"), F.col("target")
    up = t >= F.col("source_size")
    h = (
        hist.withColumn("least", F.min(F.when(F.col("n") > 0, n)).over(w))
        .withColumn("spread", F.sum(c * n * n).over(w) / F.col("source_size"))
        .withColumn("gap", F.log(t / F.col("source_size")))
        .withColumn("lo", F.when(up, F.lit(0.0)).otherwise(F.col("gap") / F.col("least")))
        .withColumn("hi", F.when(up, F.log(F.lit(float(cap))) / F.col("least")).otherwise(F.lit(0.0)))
        .withColumn("tilt", F.col("gap") / F.col("spread"))
        .drop("least", "spread", "gap")
    )
    for _ in range(steps):
        e = F.exp(F.col("tilt") * n)
        h = h.withColumns({"got": F.sum(c * n * F.least(F.lit(float(cap)), e)).over(w), "slope": F.sum(F.when(e < cap, c * n * n * e).otherwise(0.0)).over(w)})
        over = F.col("got") > t
        h = h.withColumns({"lo": F.when(over, F.col("lo")).otherwise(F.col("tilt")), "hi": F.when(over, F.col("tilt")).otherwise(F.col("hi"))})
        h = h.withColumn("step", F.when(F.col("slope") > 0, F.col("tilt") - F.log(F.col("got") / t) * F.col("got") / F.col("slope")))
        h = h.withColumn("tilt", F.when((F.col("step") > F.col("lo")) & (F.col("step") < F.col("hi")), F.col("step")).otherwise((F.col("lo") + F.col("hi")) / 2))
    full = t >= F.col("source_size") * cap * (1 - 1e-12)
    rate = F.when(F.col("source_size") == 0, 1.0).when(full, float(cap)).otherwise(F.least(F.lit(float(cap)), F.exp(F.col("tilt") * n)))
    return h.withColumn("rate", rate).drop("lo", "hi", "tilt", "got", "slope", "step")


def round_copies(h: DataFrame, cap: int = CAP, repairs: int = REPAIRS) -> DataFrame:
    """Add base (copies of every document of a class) and extra (documents that get one more).

    Extras follow the running sum of the fractions from long to short, then a few single documents
    close what is left of the gap to the target.
    """
    w = Window.partitionBy("key").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    down = Window.partitionBy("key").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    n = F.col("n")
    h = h.withColumn("base", F.floor("rate")).withColumn("part", F.col("c") * (F.col("rate") - F.col("base")))
    h = h.withColumn("run", F.sum("part").over(down))
    h = h.withColumn("extra", F.floor(F.col("run") + 0.5) - F.floor(F.col("run") - F.col("part") + 0.5))
    h = h.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("c"), F.col("extra"))))
    for _ in range(repairs):
        h = h.withColumn("miss", F.col("target") - F.sum(n * (F.col("base") * F.col("c") + F.col("extra"))).over(w))
        can = F.when(F.col("miss") > 0, (F.col("extra") < F.col("c")) & (F.col("base") < cap)).otherwise(F.col("extra") > 0) & (n > 0)
        h = h.withColumn("off", F.when(can, F.abs(F.abs("miss") - n)))
        h = h.withColumn("best", F.min(F.when(F.col("off").isNotNull(), F.struct("off", "n"))).over(w))
        take = F.col("off").isNotNull() & (F.col("best.n") == n) & (F.col("off") < F.abs("miss"))
        h = h.withColumn("extra", F.when(take, F.col("extra") + F.signum("miss").cast("long")).otherwise(F.col("extra")))
    return h.drop("part", "run", "miss", "off", "best")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: list[str] | None = None) -> DataFrame:
    """Documents with size, source_size, target, rate, copies and taken (words, repeats counted).

    keep: the document columns that go on (all if None).
    """
    with_checkpoint_dir(docs.sparkSession)
    made = ["size", "source_size", "target", "rate", "copies", "taken"]
    on = kept(docs, keep, made)
    split = max(64, docs.count() // CELL_ROWS)
    ours = {
        "_n": word_count(F.col(text)),
        "_key": F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")),
        "_by": F.xxhash64(doc_id),
        "_source": F.col(source),
        "_id": F.col(doc_id),
    }
    d = docs.select(row(on).alias("_row"), *(v.alias(k) for k, v in ours.items())).withColumn("_cell", F.pmod("_by", F.lit(split)))
    cells = d.groupBy("_key", "_n", "_cell").agg(F.count("*").alias("cc"), F.first("_source").alias("source")).checkpoint()
    hist = cells.groupBy(F.col("_key").alias("key"), F.col("_n").alias("n")).agg(F.sum("cc").alias("c"), F.first("source").alias("source"))
    sources = hist.groupBy("key").agg(F.first("source").alias("source"), F.sum(F.col("n") * F.col("c")).alias("source_size"))
    plan = round_copies(balance(hist.drop("source").join(source_targets(sources, weights, cap).drop("source"), "key"), cap), cap)
    class_ = Window.partitionBy("key", "n").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("cc").over(class_)
    part = lambda x: F.floor(F.col("extra").cast("double") * x / F.col("c"))
    dealt = (
        cells.select(F.col("_key").alias("key"), F.col("_n").alias("n"), "_cell", "cc")
        .join(plan, ["key", "n"])
        .withColumn("more", part(upto) - part(upto - F.col("cc")))
        .select(F.col("key").alias("_key"), F.col("n").alias("_n"), "_cell", "source_size", "target", "rate", "base", "more")
    )
    rank = F.row_number().over(Window.partitionBy("_key", "_n", "_cell").orderBy("_by", "_id"))
    return (
        d.join(dealt, ["_key", "_n", "_cell"])
        .withColumn("copies", (F.col("base") + (rank <= F.col("more")).cast("int")).cast("int"))
        .select(*unpacked(on), F.col("_n").alias("size"), "source_size", "target", "rate", "copies", (F.col("_n") * F.col("copies")).alias("taken"))
    )
