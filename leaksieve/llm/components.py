"""Connected components of a link table, by alternating star steps, with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaksieve.llm.tables import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over (a, b): every node links its larger (or smaller and own) neighbours to its least neighbour.

    The least neighbour is a partial aggregate that joins back, so a hub's neighbours never meet in one task.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """edges (a long, b long), any order, loops and repeats allowed -> (node, label): label is the least node of the component.

    Nodes without a link to another node are absent. Each round is two shuffles of the links; the number of rounds grows with
    the logarithm of the longest path.
    """
    now = staged(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    before = None
    while True:
        now = staged(_star(_star(now, True), False))
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (state["n"], state["h"]) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
        before = (state["n"], state["h"])
