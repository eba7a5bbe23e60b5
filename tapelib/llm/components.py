"""Connected components of an edge table, by alternating large and small stars; no vertex's neighbours are ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelib.llm.store import stored


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges`` (a, b) of comparable vertices; returns ``node, comp`` for every vertex of an edge, ``comp`` the smallest
    vertex reachable.  Self-loops and repeated edges change nothing; without edges the result is empty.

    The number of rounds grows with the logarithm of the longest path; each is written to the shared folder."""
    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))

    def mark(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    seen = mark(now)
    while True:
        # large star: every larger neighbour of u is tied to the smallest vertex around u
        both = now.filter("u != v").select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stored(both.join(least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(now.filter("u = v")).distinct(), name)
        # small star: u and its smaller neighbours are tied to the smallest of them
        low = least(large)
        now = stored(large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name)
        before, seen = seen, mark(now)
        if seen == before:
            return stored(now.groupBy("u").agg(F.min("v").alias("comp")).withColumnRenamed("u", "node"), name)
