"""Connected components of a link table in rounds of joins, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.scale import checkpoint, drop_step


def smallest_reachable(links: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """``name, component``: for every end of a link the smallest end that it reaches.

    Alternates two steps until nothing changes: every node hangs its larger neighbours on its smallest
    one, then its smaller neighbours. Both keep components whole, and the number of rounds grows
    with the logarithm of their size. Rows of a hot node are split by the join, and its smallest
    neighbour is found by a sum before the shuffle.
    """
    edges = checkpoint(
        links.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).where("x <> y").distinct()
    )
    before = None
    while True:
        both = edges.union(edges.select("y", "x"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        large = checkpoint(large.where("x <> y"))
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y")
        old = edges, large
        edges = checkpoint(small.union(least.select("x", "m")).distinct())
        drop_step(*old)
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    ends = edges.select(F.col("x").alias(name), F.col("y").alias("component"))
    roots = edges.select(F.col("y").alias(name), F.col("y").alias("component")).distinct()
    return ends.union(roots)
