"""Connected components by alternating large-star and small-star steps; ids never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fitted


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, comp) of every id in ``links``: ``comp`` is the smallest id of its component.

    An edge set ends as stars around the smallest ids after a number of rounds that grows with the
    logarithm of the longest chain.  Each step is a minimum by key and a join back, so no list of
    neighbours is ever gathered.
    """
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    edges = links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u > v").distinct()
    edges = checkpointed(edges)
    before = _state(edges)
    while before[0]:
        edges = fitted(edges, before[0])
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = checkpointed(small.select("e.u", "e.v").filter("u > v").distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("comp"))
    return stars.union(edges.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())
