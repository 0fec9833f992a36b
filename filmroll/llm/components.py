"""Connected components of an edge table by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond", SoCC 2014. Each
round is a few joins and aggregates; the edges are written to the shared folder
between rounds. Nothing is collected but two numbers that tell whether a round
still changed something.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmroll.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (or the smaller) neighbours of every node onto its smallest one."""
    if large:
        around = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = around.join(least.hint("merge"), "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    hung = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return hung.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node and root (the least node reachable) of all nodes in ``edges`` (u, v: long), but for the roots themselves."""
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    edges = materialize(edges.select("u", "v").where("u <> v").distinct())
    before = None
    while True:
        edges = materialize(_star(_star(edges, large=True), large=False))
        now = state(edges)
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
