"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspan.llm._store import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of edges (columns a, b).

    Stars are contracted until nothing moves, in a number of rounds that grows with the
    logarithm of the longest path. Minima are partial aggregates and the joins back may be
    split, so one node with very many links does not hold up a task. Each round is written to
    the shared folder, which cuts the lineage, and tells in the same pass whether anything moved.
    """
    state = F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", *state)
    moved = bool(now.stats[0])
    while moved:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = written(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        ends = F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        after = written(large.join(least, "a").select(F.explode(ends).alias("e")).select("e.*").where("a <> b").distinct(), "small", *state)
        moved = after.stats != now.stats
        dropped(large, now)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
