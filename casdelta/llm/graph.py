"""Connected components of a table of links, by alternating stars; no list of neighbours is ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casdelta.llm.common import staged


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """Return (node, label), label being the least node of the component, for every node of edges (a, b, both long, not null).

    Each round links every node's larger neighbours to its least neighbour, then its smaller ones, which about halves the depth. It
    takes a minimum a node (summed map-side) and a join that Spark can split where a node is hot. Links of a node with itself
    and repeated links are harmless. Rounds end when nothing changes.
    """

    def least(pairs: DataFrame) -> DataFrame:
        # written out, so that the join below deals both its sides anew and a hot node's links can be split
        return staged(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "links-least")

    now = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least(both), "u").where("v >= u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(least(large), "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        now = staged(small.union(large.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("v"))).distinct(), "links")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("the components did not settle")
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return pairs.union(now.select(F.col("v"), F.col("v"))).groupBy("node").agg(F.min("label").alias("label"))
