"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwise.sources.staging import stage


def _pointed(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Every (u, v) with the least node m of u; plain joins, so that adaptive execution can split a node with many links."""
    return edges.join(least, "u")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (least node reachable) for every node of the links (u, v) between unlike nodes.

    Large stars hang the larger neighbours of a node on its least neighbour, small stars the smaller ones; the links shrink
    to one star per component in a number of rounds that is logarithmic in practice. Each round is written, so that a lost
    executor costs a re-read. An empty table gives an empty result."""
    held = stage(edges.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    for _ in range(rounds):
        both = held.union(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _pointed(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _pointed(large, low).select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select("u", F.col("m").alias("v"))).where("u != v").select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        held = stage(small, "links")
        state = held.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return held.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        held.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
