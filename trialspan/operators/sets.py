"""Set and interval operations. Intervals are closed on both ends unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; columns are those of any frame, first seen first."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def shared_keys(key: str, *frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.intersect(b), (f.select(key) for f in frames))


def only_in(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    return first.select(key).distinct().join(second.select(key), key, "left_anti")


def _dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """df dealt by keys into as many partitions as shuffles have. They are not put together by their bytes: intervals compress well, and a task would sort many more rows than its memory suits."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def joined_intervals(df: DataFrame, keys: list[str], lo: str, end: str, touching_only: bool = False) -> DataFrame:
    """(keys, lo, end) of half-open intervals joined where they touch, and where they overlap unless touching_only. Those without lo come last and begin nothing, unless a key has no others."""
    df = _dealt(df.select(*keys, lo, end), keys)
    w = Window.partitionBy(*keys).orderBy(F.col(lo).asc_nulls_last(), F.col(end).asc_nulls_last())
    before = F.lag(end).over(w) if touching_only else F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (before.isNull() | ((before != F.col(lo)) if touching_only else (before < F.col(lo)))).cast("int")
    rows = df.select(*keys, lo, end).withColumn("__new", new).withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "__island").agg(F.min(lo).alias(lo), F.max(end).alias(end)).drop("__island")


def interval_gaps(df: DataFrame, keys: list[str], lo: str, end: str, start: Column, stop: Column) -> DataFrame:
    """(keys, lo, end): what the half-open intervals leave of [start, stop)."""
    merged = joined_intervals(df, keys, lo, end)
    w = Window.partitionBy(*keys).orderBy(lo)
    after = F.struct(F.greatest(F.col(end), start).alias("lo"), F.least(F.coalesce(F.lead(lo).over(w), stop), stop).alias("end"))
    ahead = F.when(F.row_number().over(w) == 1, F.struct(start.alias("lo"), F.least(F.col(lo), stop).alias("end")))
    gaps = merged.select(*keys, after.alias("after"), ahead.alias("ahead")).select(*keys, F.explode(F.array("after", "ahead")).alias("g"))
    return gaps.where("g.lo < g.end").select(*keys, F.col("g.lo").alias(lo), F.col("g.end").alias(end))


def share(first: Column, count: Column, index: Column, jobs: int) -> tuple[Column, Column]:
    """(first, last) seed of job `index` of `jobs` in a balanced split."""
    low = first + F.floor(index * count / jobs)
    return low, first + F.floor((index + 1) * count / jobs) - 1


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys with the place of their first row."""
    return df.groupBy(key).agg(F.min(order).alias("place"))


def grid(spark, axes: dict[str, list]) -> DataFrame:
    """Every combination of the axis values, numbered in order with the last axis fastest; repeated values of an axis are refused."""
    for name, values in axes.items():
        if len(set(values)) != len(values):
            raise ValueError(f"axis {name} repeats a value")
    out = spark.range(1).select(F.lit(0).cast("long").alias("cell"))
    for name, values in axes.items():
        out = out.select("*", F.posexplode(F.array(*map(F.lit, values))).alias("__at", name)).withColumn("cell", F.col("cell") * len(values) + F.col("__at")).drop("__at")
    return out


def tiling(df: DataFrame, keys: list[str], lo: str, hi: str, first: Column, last: Column, bits: str) -> DataFrame:
    """(keys, tiles, folded): whether closed ranges tile [first, last] without gap or overlap, and the XOR of their bits, null if any is null."""
    w = Window.partitionBy(*keys).orderBy(lo)
    rows = df.where((F.col(lo) <= last) & (F.col(hi) >= first)).withColumn("__ok", F.coalesce(F.lag(hi).over(w) + 1 == F.col(lo), F.lit(True)))
    tiles = F.bool_and("__ok") & (F.min(lo) == F.first(first)) & (F.max(hi) == F.first(last))
    return rows.groupBy(*keys).agg(tiles.alias("tiles"), F.when(F.count_if(F.col(bits).isNull()) == 0, F.bit_xor(bits)).alias("folded"))
