"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm._spill import discard, written


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(u, root) for every node of ``edges`` (u, v) but the roots; the root is a component's least node.

    An edge goes from its greater node u to its lesser one v.  A round hangs u
    on the least neighbour of v (large star), then all lesser neighbours of a
    node on the least of them (small star).  Minima are grouped, so they are
    added up before rows move, and are tables of their own: a join of the edges
    with them has an exchange on both sides, so that adaptive execution can
    split the edges of a node with very many.  A node that is the least of its
    neighbours, as the root of a star is, needs no lookup and is left out.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if now.isEmpty():
        return now.select("u", F.col("v").alias("root"))
    for _ in range(rounds):
        both = now.select("u", F.col("v").alias("x")).unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("x")))
        least = written(both.groupBy("u").agg(F.min("x").alias("m")).where("m < u").select(F.col("u").alias("v"), "m"), "least")
        large = written(now.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct(), "large")
        if large.join(least.select(F.col("v").alias("u"), "m"), "u").where("v <> m").isEmpty():
            return large.select("u", F.col("v").alias("root"))  # stars: every node hangs on its least neighbour, and that on none
        low = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "low")
        small = large.join(low.where("n > 1").select("u", "m"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        for table in (least, large, low):
            discard(table)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
