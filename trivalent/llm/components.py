"""Connected components by alternating large and small stars, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _stars(pairs: DataFrame, nodes: str) -> DataFrame:
    """pairs (u, v): each node u with the least of itself and its v; then every v of u points there."""
    least = pairs.groupBy(nodes).agg(F.min("v").alias("m")).withColumn("m", F.least("m", nodes))
    return pairs.join(least, nodes)


def _kept(pairs: DataFrame) -> DataFrame:
    return checkpointed(pairs.where("u <> v").distinct())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: the smallest node that is reachable, for every node of at least one edge.

    Edges may repeat, run either way, or be loops; those with a null end are left out.
    Each round halves the depth of the trees at least; rounds end when nothing changes.
    State is written to the shared folder in each round.
    """
    pairs = _kept(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull()))
    before = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        joined = _stars(large, "u")
        small = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        pairs = _kept(small)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
