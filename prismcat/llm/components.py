"""Connected components over an edge table, by alternating large-star and small-star rounds.

Every round is a pre-aggregated minimum and one join whose skewed side Spark can split; a hub with very
many neighbours is never gathered. Rounds are written to the shared folder, so lost executors cost a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismcat.session import materialise


def _minima(edges: DataFrame, label: str) -> DataFrame:
    return materialise(edges.groupBy("u").agg(F.min("v").alias("m")), label)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component`` (the smallest node it reaches) of every node of an edge.

    Direction, repeats and loops of edges don't matter; edges with NULL are ignored. No edges, no rows.
    """
    known = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = materialise(known.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")), "link-pairs")
    loops = pairs.filter("u = v").select("u")
    links = materialise(pairs.filter("u > v").distinct(), "links")
    alone = materialise(loops.distinct(), "link-loops")
    before = None
    while (now := _state(links)) != before:
        before = now
        # large star: larger neighbours of u move to the smallest node around u
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _minima(both, "star-minima").withColumn("m", F.least("u", "m"))
        links = materialise(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        # small star: smaller neighbours of u and u itself move to the smallest of them
        joined = links.join(_minima(links, "star-minima"), "u")
        moved = joined.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = materialise(moved.unionByName(joined.select("u", F.col("m").alias("v"))).distinct(), "small-star")
    roots = links.select(F.col("v").alias("u")).unionByName(alone.join(links.select("u"), "u", "left_anti")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select(F.col("u").alias("node"), F.col("u").alias("component"))
    )
