"""Connected components by alternating large and small stars, in Spark joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge that joins two different nodes.

    component is the smallest node reachable. Edges may repeat, run both ways, join a node to itself or hold
    nulls; the last two link nothing. Each round is two aggregates by node (with partial sums, so that a hub costs
    one row per task), written before they are joined back, so that Spark can split a hub's rows; edges end as stars
    and their number never grows. Rounds go on until nothing changes.
    """
    pairs = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = cut(pairs.distinct())
    state, was = _state(now), None
    while state[0] and state != was:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        root = cut(large.groupBy("hi").agg(F.min("lo").alias("m")))
        stars = large.join(root, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")),
                                                                F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        then = cut(stars.select("e.*").where("hi <> lo").distinct())
        release(now, least, root)
        now, was, state = then, state, _state(then)
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("component"))).distinct()
