"""Sharding by histogram sort.

Documents are ordered by a 120-bit key (a hash of the text, then a hash of the id). The splitters
between shards are found by counting: each round sums the exact bytes in 4096 equal parts of every
key range that still holds an undecided splitter or too many rows, until each splitter lies at the
edge of a range (or within the tolerance of one). Then the documents are exchanged once.

A row's shard is floor(shards * bytes before its key / all bytes), so sizes differ by about one
document. A hot group of equal texts is split by the second half of the key. The driver keeps some
thousand cells of keys; where such a cell would have more than CELL_ROWS rows, it is cut into slices
by further bits of the key, which are counted and summed up by Spark.

Defined cases: a null text has no bytes and the key of an empty one; rows without an id are numbered
once, so equal texts among them are parted like others; rows with equal text and id have one key and stay in one shard; an empty table gives no
rows; a document column with the name of a result column is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from argosy.llm.common import kept, row, unpacked
from argosy.session import with_checkpoint_dir

SHARDS = 24
STEP = 12
HALF = 60
DEPTH = 2 * HALF // STEP
#: A range of keys with more than this part of all rows is refined, which bounds what the driver keeps.
HEAVY = 1024
#: A task sorts about so many rows at most.
CELL_ROWS = 1_000_000


def key_of(x: Column) -> Column:
    """The first 60 bits of an MD5, as a non-negative long."""
    return F.conv(F.substring(F.md5(F.coalesce(x.cast("string"), F.lit(""))), 1, HALF // 4), 16, 10).cast("long")


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of numbers from the driver, parsed by Spark itself from one text."""
    body = ";".join(",".join(map(str, r)) for r in rows)
    names = [c.strip().split() for c in schema.split(",")]
    fields = F.split("x", ",")
    lines = spark.range(1).select(F.explode(F.split(F.lit(body), ";")).alias("x")).filter("x != ''")
    return lines.select(*(F.get(fields, F.lit(i)).cast(t).alias(n) for i, (n, t) in enumerate(names)))


def _prefix(level: int) -> tuple[Column, Column]:
    """The first ``level`` steps of the key, as two numbers."""
    return (F.shiftright("k1", max(0, HALF - STEP * level)), F.shiftright("k2", HALF - max(0, STEP * level - HALF)))


def find_ranges(keys: DataFrame, shards: int, tolerance: float = 0.0) -> tuple[list[tuple], int, int]:
    """Key ranges (low, bytes, rows, level, one key only) in order, refined as far as is needed, with all bytes and rows.

    What comes to the driver is a histogram: at most 4096 rows for each of some tens of ranges.
    """
    spark = keys.sparkSession
    size, rows = F.sum("size"), F.count("*")
    one = F.min(F.struct("k1", "k2")) == F.max(F.struct("k1", "k2"))

    def histogram(df: DataFrame, level: int) -> list[tuple]:
        a, b = _prefix(level)
        found = df.groupBy(a.alias("a"), b.alias("b")).agg(size.alias("s"), rows.alias("n"), one.alias("o")).collect()
        low = lambda r: (r.a << max(0, HALF - STEP * level), r.b << (HALF - max(0, STEP * level - HALF)))
        return [(low(r), r.s, r.n, level, r.o) for r in found]

    ranges = sorted(histogram(keys, 1))
    total, count = sum(r[1] for r in ranges), sum(r[2] for r in ranges)
    for level in range(1, DEPTH):
        open_, before = [], 0
        for r in ranges:
            if r[3] == level and not r[4]:
                # an undecided splitter k * total / shards lies inside, further than the tolerance from either edge
                k = before * shards // total + 1
                inside = k * total < (before + r[1]) * shards
                near = min(k * total - before * shards, (before + r[1]) * shards - k * total) <= tolerance * total
                if inside and not near or r[2] > max(count // HEAVY, 1000):
                    open_.append(r)
            before += r[1]
        if not open_:
            break
        a, b = _prefix(level)
        probes = literal_table(spark, [(r[0][0] >> max(0, HALF - STEP * level), r[0][1] >> (HALF - max(0, STEP * level - HALF))) for r in open_], "pa long, pb long")
        inner = keys.join(F.broadcast(probes), (a == F.col("pa")) & (b == F.col("pb")), "left_semi")
        done = set(open_)
        ranges = sorted([r for r in ranges if r not in done] + histogram(inner, level + 1))
    return ranges, total, count


def find_cells(ranges: list[tuple], total: int, count: int, shards: int) -> list[tuple]:
    """Cells (bin, low, high, shard, rows before it in its shard): neighbouring ranges of one bin and shard, joined while small."""
    cells, before, seen = [], 0, [0] * shards
    for (low, size, n, _, _) in ranges:
        shard = before * shards // total if total else 0
        bin_ = low[0] >> (HALF - STEP)
        last = cells[-1] if cells else None
        if last and last["bin"] == bin_ and last["shard"] == shard and last["n"] + n <= max(count // HEAVY, 1000):
            last["n"] += n
        else:
            cells.append({"bin": bin_, "low": low, "shard": shard, "slot": seen[shard], "n": n})
        seen[shard] += n
        before += size
    ends = [c["low"] for c in cells[1:]] + [(1 << HALF, 0)] * bool(cells)
    return [(c["bin"], *c["low"], *end, c["shard"], c["slot"], i) for i, (c, end) in enumerate(zip(cells, ends, strict=True))]


def slice_bits(count: int, cell_rows: int) -> int:
    """How many further bits of the key cut the largest cells down to about ``cell_rows`` rows."""
    return max(0, math.ceil(math.log2(max(1, count) / HEAVY / cell_rows)))


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = 0.0, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Documents with size (bytes of text plus 8), shard and slot (from 0, without gaps, in key order).

    keep: the document columns that go on (all if None).
    """
    spark = with_checkpoint_dir(docs.sparkSession)
    on = kept(docs, keep, ["size", "shard", "slot"])
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    d = docs.select(row(on).alias("_row"), key_of(F.col(text)).alias("k1"), F.col(doc_id).alias("_id"), size.alias("size"))
    # the numbers of rows without an id must not change between the passes, so these rows are written with them
    unnamed = d.filter("_id IS NULL").withColumn("k2", key_of(F.monotonically_increasing_id())).checkpoint()
    d = d.filter("_id IS NOT NULL").withColumn("k2", key_of(F.col("_id"))).unionByName(unnamed).drop("_id")
    keys = d.select("k1", "k2", "size").checkpoint()
    ranges, total, count = find_ranges(keys, shards, tolerance)
    cells = find_cells(ranges, total, count, shards)
    made = literal_table(spark, cells, "bin long, l1 long, l2 long, h1 long, h2 long, shard int, base long, cell int")
    k1, k2 = F.col("k1"), F.col("k2")
    at_least = (k1 > F.col("l1")) | ((k1 == F.col("l1")) & (k2 >= F.col("l2")))
    below = (k1 < F.col("h1")) | ((k1 == F.col("h1")) & (k2 < F.col("h2")))
    bits = slice_bits(count, CELL_ROWS)
    # the slices of a cell in key order: the next bits of the text's hash, then of the id's hash, which alone parts equal texts
    cut = [F.shiftright("k1", max(0, HALF - STEP - bits)).alias("s1"), F.shiftright("k2", max(0, HALF - bits)).alias("s2")]

    def in_cells(df: DataFrame) -> DataFrame:
        found = df.join(F.broadcast(made), (F.shiftright("k1", HALF - STEP) == F.col("bin")) & at_least & below)
        return found.select("*", *cut)

    placed = in_cells(d)
    if bits:
        before = Window.partitionBy("cell").orderBy("s1", "s2").rowsBetween(Window.unboundedPreceding, -1)
        sizes = in_cells(keys).groupBy("cell", "s1", "s2").agg(F.count("*").alias("n"))
        sizes = sizes.select("cell", "s1", "s2", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
        placed = placed.join(sizes, ["cell", "s1", "s2"])
    else:
        placed = placed.withColumn("skip", F.lit(0))
    by = ["cell", "s1", "s2"] if bits else ["cell"]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("k1", "k2"))
    return placed.withColumn("slot", F.col("base") + F.col("skip") + rank - 1).select(*unpacked(on), "size", "shard", "slot")
