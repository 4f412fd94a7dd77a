"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.session import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v: every neighbourhood is tied to its least member."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    tied = both.join(least, "u")
    if large:
        moved = tied.where("v > u AND v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = tied.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionAll(tied.where("u > m").select("u", F.col("m").alias("v")))
    return moved.distinct()


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(u, root): the least member of the component of every linked node but that member itself.

    With `rounds`, it may stop early: nodes with one root are linked then too, but nodes with
    different roots may be as well. A neighbourhood of any size is added up before the shuffle.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialise(edges, "edges")
    before = None
    done = 0
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before or not state["n"] or done == rounds:
            break
        before = state
        edges = materialise(_star(edges, large=True), "large-star")
        edges = materialise(_star(edges, large=False), "small-star")
        done += 1
    return edges.groupBy("u").agg(F.min("v").alias("root"))
