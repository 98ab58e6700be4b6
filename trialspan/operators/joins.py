"""Joins: spans, ranges by bucket, ownership, pairing, and referential checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_stages(windows: DataFrame, stages: DataFrame, keys: list[str], ordinal: str, ordinals: str) -> DataFrame:
    """Windows with the stages whose array of ordinals holds the window's: exploded, so the join is by equality."""
    rows = stages.withColumn(ordinal, F.explode(ordinals)).drop(ordinals)
    return windows.join(rows, [*keys, ordinal])


def served(stages: DataFrame, own: str, others: str, out: str) -> DataFrame:
    """A row for each window that a stage serves, its own and those batched with it."""
    return stages.withColumn(out, F.explode(F.array_union(F.array(own), F.coalesce(F.col(others), F.array())))).drop(own, others)


def with_defaults(left: DataFrame, lookups: list[tuple[DataFrame, list[str], dict[str, Column]]]) -> DataFrame:
    """Left joins one after another; a column that found no row takes its default."""
    for right, keys, defaults in lookups:
        left = left.join(right, keys, "left").withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})
    return left


def range_join(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, lo: str, hi: str, width: int, how: str = "inner") -> DataFrame:
    """Points with the closed ranges [lo, hi] of the same key that hold them.

    Both sides are dealt into buckets of `width`, so the join is by equality and may be shuffled;
    a range stands in each bucket that it touches, a point in one, so no pair comes twice.
    """
    cut = ranges.withColumn("__b", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    dealt = points.withColumn("__b", F.floor(F.col(at) / width))
    test = (dealt["__b"] == cut["__b"]) & (dealt[at] >= cut[lo]) & (dealt[at] <= cut[hi])
    for k in keys:
        test = (dealt[k] == cut[k]) & test
    out = dealt.join(cut, test, how)
    drop = [cut[k] for k in keys] + [cut["__b"], dealt["__b"]] if how not in ("left_semi", "left_anti") else ["__b"]
    return out.drop(*drop)


def shallowest_owner(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, lo: str, hi: str, owner: str, depth: str, width: int, point: str) -> DataFrame:
    """(keys, point, owner, ties): each point goes to the range of least depth that holds it; ties counts ranges of that depth."""
    found = range_join(points, ranges, keys, at, lo, hi, width)
    by_depth = found.groupBy(*keys, point, depth).agg(F.min(owner).alias("__owner"), F.count(F.lit(1)).cast("int").alias("__ties"))
    best = by_depth.groupBy(*keys, point).agg(F.min_by(F.struct("__owner", "__ties"), depth).alias("m"))
    return best.select(*keys, point, F.col("m.__owner").alias(owner), F.col("m.__ties").alias("ties"))


def paired(key: list[str], **frames: DataFrame) -> DataFrame:
    """Rows of the keys that all frames hold; other columns get the frame's name before theirs."""
    out = None
    for name, f in frames.items():
        f = f.select(*key, *(F.col(c).alias(f"{name}_{c}") for c in f.columns if c not in key))
        out = f if out is None else out.join(f, key)
    return out


def repeated(df: DataFrame, key: list[str], folder: str) -> DataFrame:
    """Keys that more than one folder holds."""
    return df.groupBy(*key).agg(F.count_distinct(folder).alias("folders")).where("folders > 1")


def missing(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Keys of df that `known` does not hold."""
    return df.select(key).distinct().join(known.select(key), key, "left_anti")


def refuse_missing(df: DataFrame, known: DataFrame, key: str) -> None:
    bad = [r[0] for r in missing(df, known, key).limit(5).collect()]
    if bad:
        raise ValueError(f"unknown {key}: {bad}")


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Left rows with the last value of the key at or before `at`: one sort of both sides together, no pairs."""
    from pyspark.sql import Window

    both = left.withColumn("__v", F.lit(None).cast(right.schema[value].dataType)).withColumn("__side", F.lit(1)).unionByName(right.select(*keys, at, F.col(value).alias("__v")).withColumn("__side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("__v", ignorenulls=True).over(w)).where("__side = 1").drop("__v", "__side")


def consensus(solves: DataFrame, key: list[str], answer: str, weight: str, forced: int) -> DataFrame:
    """(key, answer, gap) of the keys whose forced solves have all arrived: the least weight wins, the gap is to the next."""
    g = solves.groupBy(*key).agg(F.min_by(answer, F.struct(weight, answer)).alias(answer), F.array_sort(F.collect_list(weight)).alias("w"), F.count("*").alias("n"))
    return g.where(F.col("n") >= forced).select(*key, answer, (F.col("w")[1] - F.col("w")[0]).alias("gap"))


def routes(pools: DataFrame, edges: DataFrame, pool: str) -> DataFrame:
    """Pairs of pools that an edge joins, by two equality joins instead of a product."""
    a = pools.select(F.col(pool).alias("source"))
    b = pools.select(F.col(pool).alias("target"))
    return edges.join(a, "source").join(b, "target").select("source", "target")


def checked_answers(df: DataFrame, escalated: Column, strong: Column, weak: Column, actual: Column) -> list[Column]:
    """Counts of rows, of answers as expected, and of others."""
    expected = F.when(escalated, strong).otherwise(weak)
    return [F.count("*").alias("rows"), F.count_if(expected.eqNullSafe(actual)).alias("agreed"), F.count_if(~expected.eqNullSafe(actual)).alias("differed")]


def nearest_row(df: DataFrame, table: DataFrame, keys: list[str], at: str, size: str, value: str) -> DataFrame:
    """df with the value of the table's row nearest in size, of two as near the smaller, of one size the least value.

    Different values of `at` and the table's sizes are sorted together within a key, once each way, so every frame only
    grows; rows then look their value up. Rows without a value, or whose key the table lacks, get null.
    """
    rows = table.groupBy(*keys, F.col(size).alias("__size")).agg(F.min(value).alias("__value"))
    asked = df.where(F.col(at).isNotNull()).select(*keys, F.col(at).alias("__size")).distinct()
    both = asked.withColumn("__own", F.lit(1)).unionByName(rows.where("__size is not null").withColumn("__own", F.lit(0)), allowMissingColumns=True)
    card = F.when(F.col("__own") == 0, F.struct("__size", "__value"))
    w = Window.partitionBy(*keys)
    sides = {"__below": F.col("__size"), "__above": F.col("__size").desc()}
    x = both.withColumns({n: F.last(card, ignorenulls=True).over(w.orderBy(o, "__own").rowsBetween(Window.unboundedPreceding, 0)) for n, o in sides.items()}).where("__own = 1")
    lower = F.col("__above").isNull() | (F.col("__size") - F.col("__below")["__size"] <= F.col("__above")["__size"] - F.col("__size"))
    names = [f"__k_{k}" for k in keys]
    x = x.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), "__size", F.when(lower, F.col("__below")["__value"]).otherwise(F.col("__above")["__value"]).alias(value))
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    return df.join(x, [*on, F.col(at) == F.col("__size")], "left").drop(*names, "__size")
