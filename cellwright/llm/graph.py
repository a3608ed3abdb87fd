"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.llm.common import stash

MOST_ROUNDS = 60


def _lowest(pairs: DataFrame) -> DataFrame:
    """pairs (v, u) with m, the least of v and all u of v; minima are pre-aggregated, so that a hub costs no more than its rows."""
    least = pairs.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
    return pairs.join(least, "v")


def components(edges: DataFrame) -> DataFrame:
    """v, component (the least vertex reachable) for every vertex of edges (a, b); loops and repeats count nothing."""
    current = stash(edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges")
    for _ in range(MOST_ROUNDS):
        # stars: each vertex points at one other, at which nothing but pointers end
        rows, pointing = current.agg(F.count("*"), F.count_distinct("v")).first()
        if rows == pointing and not current.join(current.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count():
            break
        both = current.unionByName(current.select(F.col("u").alias("v"), F.col("v").alias("u")))
        large = _lowest(both).filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("v <> u").distinct()
        small_in = _lowest(large)
        small = small_in.filter("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(small_in.select("v", F.col("m").alias("u"))).filter("v <> u").distinct()
        current = stash(small, "edges")
    else:
        raise RuntimeError("components didn't settle")
    return current.select("v", F.col("u").alias("component")).unionByName(current.select(F.col("u").alias("v"), F.col("u").alias("component")).distinct())
