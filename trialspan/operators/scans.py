"""Running sums and maxima along one key of any length, in blocks that many tasks share.

A window over a whole key is one task for it, however many rows it has. Here the order of each
key is cut into blocks; rows are scanned within their block, blocks are summed up to one row each,
those few rows are scanned by key, and what came before a block is carried back to its rows. So a
key of any length is spread, for one shuffle of the rows by (key, block) and a small one.

Blocks are ranges of the order column between quantiles of all rows, so a key with many rows has many blocks and
rows of one value of the order column stay together.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, about.
BLOCK_ROWS = 1_000_000
#: Blocks at most: beyond them blocks grow. Bounds are part of the plan, and the summaries that give them grow with their number.
BLOCKS = 256
#: Error of the quantiles that bound blocks, as a share of a block.
SLACK = 0.1


def blocked(df: DataFrame, order: str, rows: int | None = None) -> DataFrame:
    """df with __block: ranges of the order column of about so many rows each, at most BLOCKS of them; one block if there are fewer, or all rows are of one value."""
    rows = rows or BLOCK_ROWS
    n = df.count()
    many = min(n // rows, BLOCKS)
    if many < 2:
        return df.withColumn("__block", F.lit(0))
    numbers = df.select(F.col(order).cast("double").alias("x"))
    bounds = sorted(set(numbers.approxQuantile("x", [k / many for k in range(1, many)], SLACK / many)))
    return df.withColumn("__block", _place(F.coalesce(F.col(order).cast("double"), F.lit(float("-inf"))), bounds))


def _place(value: Column, bounds: list[float]) -> Column:
    """How many bounds are below the value, by halving: as deep as the logarithm of their number."""
    if not bounds:
        return F.lit(0)
    middle = len(bounds) // 2
    return F.when(value <= bounds[middle], _place(value, bounds[:middle])).otherwise(F.lit(middle + 1) + _place(value, bounds[middle + 1 :]))


_START = Window.unboundedPreceding


def _back(df: DataFrame, blocks: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """df with the columns `names` of the row of blocks that has its keys and block; both are dealt by them."""
    on = [*keys, "__block"]
    blocks = blocks.select(*(F.col(k).alias(f"__b_{k}") for k in on), *names)
    same = [F.col(k).eqNullSafe(F.col(f"__b_{k}")) for k in on]
    return df.join(blocks, same, "left").drop(*(f"__b_{k}" for k in on))


def _before(keys: list[str]):
    """The blocks of a key before each."""
    return Window.partitionBy(*keys).orderBy("__block").rowsBetween(_START, -1)


def _within(keys: list[str], order: Iterable[str]):
    return Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(_START, 0)


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str] | None = None, maxima: dict[str, str] | None = None, rows: int | None = None) -> DataFrame:
    """df with running sums and maxima {name: column} of each key in an order whose first column is a number. Nulls add nothing."""
    sums, maxima = sums or {}, maxima or {}
    w = _within(keys, order)
    x = blocked(df, order[0], rows)
    x = x.withColumns({n: F.sum(c).over(w) for n, c in sums.items()} | {n: F.max(c).over(w) for n, c in maxima.items()})
    totals = {f"__{n}": F.sum(c) for n, c in sums.items()} | {f"__{n}": F.max(c) for n, c in maxima.items()}
    carried = {f"__c_{n}": F.sum(f"__{n}") for n in sums} | {f"__c_{n}": F.max(f"__{n}") for n in maxima}
    blocks = x.groupBy(*keys, "__block").agg(*(c.alias(n) for n, c in totals.items()))
    x = _back(x, blocks.select(*keys, "__block", *(c.over(_before(keys)).alias(n) for n, c in carried.items())), keys, list(carried))
    added = {n: F.when(F.col(n).isNull(), F.col(f"__c_{n}")).otherwise(F.col(n) + F.coalesce(F.col(f"__c_{n}"), F.lit(0))) for n in sums}
    return x.withColumns(added | {n: F.greatest(n, f"__c_{n}") for n in maxima}).drop("__block", *carried)


def level_summary(df: DataFrame, keys: list[str], tick: str, order: str, level: str, end: Column | None = None, start: Column | None = None, rows: int | None = None) -> DataFrame:
    """(keys, area, span, mean, peak) as analytic.level_summary gives them: the next tick of a block's last row is the first tick of the key's next block."""
    last = blocked(df.groupBy(*keys, tick).agg(F.max_by(level, order).alias("level")), tick, rows)
    firsts = last.groupBy(*keys, "__block").agg(F.min(tick).alias("__first"))
    after = Window.partitionBy(*keys).orderBy("__block")
    firsts = firsts.select(*keys, "__block", F.lead("__first").over(after).alias("__next"))
    x = _back(last, firsts, keys, ["__next"])
    until = F.coalesce(F.lead(tick).over(Window.partitionBy(*keys, "__block").orderBy(tick)), "__next")
    x = x.withColumn("until", until)
    close = F.coalesce("until", end if end is not None else F.col(tick))
    begin = F.greatest(F.col(tick), start) if start is not None else F.col(tick)
    x = x.withColumn("held", F.greatest(close - begin, F.lit(0)))
    counts = (F.col("held") > 0) | F.col("until").isNull()
    out = x.groupBy(*keys).agg(F.sum(F.col("level") * F.col("held")).alias("area"), F.sum("held").alias("span"), F.max(F.when(counts, F.col("level"))).alias("peak"))
    return out.withColumn("mean", F.when(F.col("span") > 0, F.col("area") / F.col("span")))


def sweep_line_peak(df: DataFrame, keys: list[str], start: str, end: str, rows: int | None = None) -> DataFrame:
    """(keys, peak) as analytic.sweep_line_peak gives it: the peak within a block on top of what the blocks before leave open."""
    marks = df.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("tick"), F.lit(1).alias("d")), F.struct(F.col(end).alias("tick"), F.lit(-1).alias("d")))).alias("m")).select(*keys, "m.tick", "m.d")
    net = blocked(marks.groupBy(*keys, "tick").agg(F.sum("d").alias("d")), "tick", rows)
    blocks = net.withColumn("now", F.sum("d").over(_within(keys, ["tick"]))).groupBy(*keys, "__block").agg(F.max("now").alias("high"), F.sum("d").alias("left"))
    before = F.coalesce(F.sum("left").over(_before(keys)), F.lit(0))
    return blocks.withColumn("high", F.col("high") + before).groupBy(*keys).agg(F.max("high").alias("peak"))


def serial_channel(df: DataFrame, keys: list[str], order: list[str], ready: str, service: str, propagation: int = 0, rows: int | None = None) -> DataFrame:
    """df with start, end and landed as analytic.serial_channel gives them.

    A row ends at S + max(ready - (S - service)) over the rows up to it, S the running service. A
    block of total T whose own maximum is M adds T and, behind services C, M - C: both carry over blocks.
    """
    w = _within(keys, order)
    x = blocked(df, order[0], rows).withColumn("__sum", F.sum(service).over(w))
    x = x.withColumn("__own", F.col(ready) - (F.col("__sum") - F.col(service))).withColumn("__slack", F.max("__own").over(w))
    by_key = _before(keys)
    blocks = x.groupBy(*keys, "__block").agg(F.sum(service).alias("__t"), F.max("__own").alias("__m"))
    blocks = blocks.withColumn("__c", F.coalesce(F.sum("__t").over(by_key), F.lit(0)))
    blocks = blocks.withColumn("__high", F.max(F.col("__m") - F.col("__c")).over(by_key)).drop("__t", "__m")
    x = _back(x, blocks, keys, ["__c", "__high"])
    x = x.withColumn("end", F.col("__sum") + F.col("__c") + F.greatest(F.col("__slack") - F.col("__c"), "__high"))
    return x.withColumns({"start": F.col("end") - F.col(service), "landed": F.col("end") + propagation}).drop("__block", "__sum", "__own", "__slack", "__c", "__high")


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, rows: int | None = None) -> DataFrame:
    """left with the last value of the key at or before `at`, as joins.asof gives it: what a block lacks is the last value of the blocks before."""
    right = right.select(*keys, at, F.col(value).alias("__v")).withColumn("__side", F.lit(0))
    both = left.withColumn("__v", F.lit(None).cast(right.schema["__v"].dataType)).withColumn("__side", F.lit(1)).unionByName(right, allowMissingColumns=True)
    x = blocked(both, at, rows)
    x = x.withColumn("__here", F.last("__v", ignorenulls=True).over(_within(keys, [at, "__side"])))
    known = F.when(F.col("__v").isNotNull(), F.col(at))
    blocks = x.groupBy(*keys, "__block").agg(F.max_by("__v", known).alias("__last"))
    x = _back(x, blocks.withColumn("__last", F.last("__last", ignorenulls=True).over(_before(keys))), keys, ["__last"])
    return x.withColumn(value, F.coalesce("__here", "__last")).where("__side = 1").drop("__block", "__v", "__side", "__here", "__last")


def nearest_percentile(counts: DataFrame, keys: list[str], value: str, fractions: dict[str, float], rows: int | None = None) -> DataFrame:
    """(keys, a column for each fraction) of value counts (keys, value, count), as aggregates.nearest_percentile gives it."""
    x = running(counts, keys, [value], sums={"__cum": "count"}, rows=rows)
    total = counts.groupBy(*keys).agg(F.sum("count").alias("__n"))
    x = _back(x.withColumn("__block", F.lit(0)), total.withColumn("__block", F.lit(0)), keys, ["__n"])
    return x.groupBy(*keys).agg(*(F.min(F.when(F.col("__cum") > F.bround((F.col("__n") - 1) * F.lit(f)), F.col(value))).alias(name) for name, f in fractions.items()))
