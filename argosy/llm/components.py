"""Connected components of a graph that is held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argosy.session import with_checkpoint_dir


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of (a, b) that has a link.

    Alternating star rounds: large stars hang each node's larger neighbours on its smallest one, small stars hang the
    smaller ones; trees flatten until nothing changes. Each round is a group and a join by node and is checkpointed;
    only a count and a checksum come to the driver. Links to oneself and repeated links do nothing.
    """
    with_checkpoint_dir(links.sparkSession)
    tidy = lambda df: df.filter(F.col("u") != F.col("v")).distinct()
    e = tidy(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))).checkpoint()
    mark = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = tidy(both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = tidy(small.unionByName(low.select("u", F.col("m").alias("v")))).checkpoint()
        new = tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
