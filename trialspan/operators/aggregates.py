"""Aggregates as generic functions of columns. All are partial and final, so pieces add."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def role_totals(df: DataFrame, keys: list[str], means: list[str] = (), maxes: list[str] = (), sums: list[str] = (), true_counts: list[str] = ()) -> DataFrame:
    """Rows, then mean, largest, sum and count of true by declared roles; a mean is over the rows that hold the column."""
    roles = [F.avg(c).alias(f"{c}_mean") for c in means] + [F.max(c).alias(f"{c}_max") for c in maxes]
    roles += [F.sum(c).alias(f"{c}_sum") for c in sums] + [F.count_if(F.col(c)).alias(f"{c}_count") for c in true_counts]
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), *roles)


def exact_sum(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The correctly rounded sum of doubles of any size, whatever the order of rows.

    A double is a whole number times a power of two. Whole numbers of one power are summed
    exactly by a partial aggregate; the at most 2,100 sums of a key are put together as
    rationals. Infinities and NaN give what plain addition gives; nulls count as nothing.
    """
    v = F.col(value).cast("double")
    wild = F.isnan(v) | v.isin(float("inf"), float("-inf"))
    power = F.greatest(F.floor(F.log2(F.abs(v))) - 54, F.lit(-1074)).cast("int")
    half = F.floor(-power / 2)
    whole = (v * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), -power - half)).cast("decimal(38,0)")
    rows = df.select(*keys, F.when(wild | (v == 0), F.lit(0)).otherwise(power).alias("__p"), F.when(wild, v).alias("__w"), F.when(v == 0, F.lit(0).cast("decimal(38,0)")).when(~wild, whole).alias("__m"))
    sums = rows.groupBy(*keys, F.coalesce("__p", F.lit(0)).alias("__p")).agg(F.sum("__m").cast("string").alias("__m"), F.sum("__w").alias("__w"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        wild, known = frame["__w"].dropna(), frame.dropna(subset=["__m"])
        total = wild.sum() if len(wild) or frame["__w"].isna().sum() < len(frame) else None
        if total is None and len(known):
            total = sum((int(m) * Fraction(2) ** int(p) for m, p in zip(known["__m"], known["__p"], strict=True)), Fraction(0))
            try:
                total = float(total)
            except OverflowError:
                total = float("inf") if total > 0 else float("-inf")
        return pd.DataFrame([[*frame[keys].iloc[0], total]], columns=[*keys, "exact_sum"]).astype({"exact_sum": "float64"})

    return sums.groupBy(*keys).applyInPandas(add, f"{fields}, exact_sum double")


#: The same under the name that tables of doubles use.
exact_float_sum = exact_sum


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The multiset of values of each key as rows (keys, value, count)."""
    return df.groupBy(*keys, value).agg(F.count("*").alias("count"))


def merged_counts(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    return counts.groupBy(*keys, value).agg(F.sum("count").alias("count"))


def nearest_percentile(counts: DataFrame, keys: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Of each multiset the sample at index round-half-even((n - 1) * fraction)."""
    w = Window.partitionBy(*keys)
    ranked = counts.withColumns({"__cum": F.sum("count").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "__n": F.sum("count").over(w)})
    return ranked.groupBy(*keys).agg(*(F.min(F.when(F.col("__cum") > F.bround((F.col("__n") - 1) * F.lit(f)), F.col(value))).alias(name) for name, f in fractions.items()))


def reach_quantile(counts: DataFrame, keys: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Of each multiset the first value at which the count reaches fraction * n."""
    w = Window.partitionBy(*keys)
    ranked = counts.withColumns({"__cum": F.sum("count").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "__n": F.sum("count").over(w)})
    return ranked.groupBy(*keys).agg(*(F.min(F.when(F.col("__cum") >= F.col("__n") * F.lit(f), F.col(value))).alias(name) for name, f in fractions.items()))


def merged_probability(p: Column) -> Column:
    """The chance that an odd number of independent flips occur."""
    return (1.0 - F.product(1.0 - 2.0 * p)) / 2.0


def ratio(top: Column, bottom: Column, none: Column | None = None) -> Column:
    """Sum over sum; `none` (null) where the second is zero."""
    return F.when(F.sum(bottom) != 0, F.sum(top) / F.sum(bottom)).otherwise(none)


def weighted_mean(value: Column, count: Column) -> Column:
    return F.sum(value * count) / F.sum(count)


def field_fold(field: Column, value: Column) -> Column:
    """Peaks and maxima fold by the largest, minima by the least, all other fields add."""
    return F.when(F.max(field.isin("peak", "maximum")), F.max(value)).when(F.max(field == "minimum"), F.min(value)).otherwise(F.sum(value))


def strict_minimum(value: Column) -> Column:
    """The least value, or null if any is null."""
    return F.when(F.count_if(value.isNull()) == 0, F.min(value))


def single_or(value: Column, other: Column) -> Column:
    """The one distinct value, or `other` if there are none or several."""
    return F.when(F.count_distinct(value) == 1, F.max(value)).otherwise(other)


def distinct_join(value: Column, separator: str = ";") -> Column:
    return F.array_join(F.array_sort(F.collect_set(value)), separator)


def ordered_digest(text: Column, order: Column, separator: str = "|") -> Column:
    """sha256 of the texts in order."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), separator), 256)


def slope(y: Column, x: Column) -> Column:
    """Least-squares slope of y on x; null below two distinct x."""
    return F.when(F.min(x) < F.max(x), F.regr_slope(y, x))


def exact_slope(y: str, x: str) -> Column:
    """The same from integer sums that do not overflow."""
    d = lambda c: F.expr(f"cast(sum(cast({c} as decimal(38,0))) as decimal(38,0))")
    n, sx, sy = F.count("*").cast("double"), d(x).cast("double"), d(y).cast("double")
    sxy, sxx = d(f"({x}) * ({y})").cast("double"), d(f"({x}) * ({x})").cast("double")
    below = n * sxx - sx * sx
    return F.when(below != 0, (n * sxy - sx * sy) / below)


def gap_histogram(df: DataFrame, keys: list[str], low: Column) -> DataFrame:
    return df.withColumn("gap_low", low).groupBy(*keys, "gap_low").agg(F.count("*").alias("count"))


def xor_fold(bits: Column) -> Column:
    """The GF(2) sum of bit vectors packed into longs."""
    return F.bit_xor(bits)


def parity_product(matrix: DataFrame, vector: DataFrame, row: str, column: str, key: str) -> DataFrame:
    """(key, row, parity): matrix (row, column) times the set bits (key, column), modulo 2."""
    return matrix.join(vector, column).groupBy(key, row).agg((F.count("*") % 2).alias("parity"))


def odd_ids(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Ids that occur an odd number of times."""
    return df.groupBy(*keys, value).agg(F.count("*").alias("n")).where("n % 2 = 1").drop("n")


def majority(df: DataFrame, keys: list[str], answer: str, position: str) -> DataFrame:
    """The most frequent answer, ties to the earliest listed, and the share that gave it."""
    counts = df.groupBy(*keys, answer).agg(F.count("*").alias("votes"), F.min(position).alias("first"))
    best = F.min_by(F.struct(answer, "votes"), F.struct(-F.col("votes"), "first", answer))
    return counts.groupBy(*keys).agg(best.alias("b"), F.sum("votes").alias("n")).select(*keys, F.col("b")[answer].alias(answer), (F.col("b.votes") / F.col("n")).alias("share"))


#: exp of less than this and of its negative is a double of full precision.
_EXP = 600.0


def sum_likelihood(df: DataFrame, keys: list[str], answer: str, weight: str) -> DataFrame:
    """The class with the largest sum of exp(-weight), of equal sums the largest class; sums are scaled by the least weight of the key where exp would leave the doubles.

    Scaled sums are rounded to the scale's own last place, which differs from the plain sum's, so keys that need no scale get none.
    Terms are added in the order of df's rows, one by one: sums of parts would be rounded by how rows are dealt to tasks. A key
    is sorted in one task. Sums never fall as terms are added, so the largest one of a class is its whole.
    """
    rows = df.select(*keys, answer, weight, F.monotonically_increasing_id().alias("__place"))
    key, term = Window.partitionBy(*keys).orderBy(answer, "__place"), Window.partitionBy(*keys, answer).orderBy("__place")
    rows = rows.withColumn("least", F.min(weight).over(key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    scale = F.when(F.abs("least") > _EXP, F.col("least")).otherwise(F.lit(0.0))
    rows = rows.withColumn("mass", F.sum(F.exp(scale - F.col(weight))).over(term.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys).agg(F.max_by(answer, F.struct("mass", answer)).alias(answer))


def batch_price(law: str, price: Column) -> Column:
    return F.sum(price) if law == "sum" else F.max(price)


def binomial(hits: Column, trials: Column) -> tuple[Column, Column]:
    """(rate, standard error)"""
    p = hits / trials
    return p, F.sqrt(p * (1.0 - p) / trials)


def count_by_kind(df: DataFrame, keys: list[str], kind: str, kinds: list[str]) -> DataFrame:
    """(keys, a column for each of the kinds, other): how many rows of each kind, 0 where there are none."""
    known = F.col(kind).isin(kinds)
    return df.groupBy(*keys).agg(*(F.count_if(F.col(kind) == k).alias(k) for k in kinds), F.count_if(~F.coalesce(known, F.lit(False))).alias("other"))


def mean_and_max(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, <value>_mean, <value>_max) of all values that df holds, in one aggregation; a value that no row holds is null."""
    held = [v for v in values if v in df.columns]
    return df.groupBy(*keys).agg(*(c for v in held for c in (F.avg(v).alias(f"{v}_mean"), F.max(v).alias(f"{v}_max"))))
