"""Connected components by alternating large-star and small-star steps, as joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v. Every node's neighbours move to the smallest of them (large: only greater neighbours)."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        linked = edges.join(least, "u")
        out = linked.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
    return out.filter(F.col("u") > F.col("v")).distinct()


def contracted(links: DataFrame, scratch: Scratch, rounds: int = 2) -> DataFrame:
    """(a, b) after a few rounds: the same components in fewer hops, a > b. Ids whose least b is equal are in one component."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    for _ in range(rounds):
        edges = scratch.save(_stars(_stars(edges, True), False))
    return edges.select(F.col("u").alias("a"), F.col("v").alias("b"))


def components(links: DataFrame, scratch: Scratch, rounds: int = 40) -> DataFrame:
    """links: (a, b) longs. Returns (id, label): the smallest id reachable, for every id that has a link to a smaller one."""
    edges = scratch.save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    seen = None
    for _ in range(rounds):
        after = scratch.save(_stars(_stars(edges, True), False))
        scratch.drop(edges)
        edges = after
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            break
        seen = state
    else:
        raise RuntimeError("components have not settled")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("label"))
