"""Interval estimates and tests. The beta quantile is plain Python, by continued fraction and bisection."""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_cdf(1.0 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 10_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            c = 1.0 + top / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return front * out


@cache
def beta_quantile(p: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if beta_cdf(mid, a, b) < p else (lo, mid)
    return (lo + hi) / 2.0


def binomial_interval(failures: int | None, shots: int | None, state: str | None) -> tuple[float | None, float | None, float | None]:
    """(estimate, low, high) at 95 percent by how the run stopped: Clopper-Pearson at a cap or minimum, the inverse-sampling limits at a target; no failures have an upper limit only."""
    if not shots or failures is None:
        return None, None, None
    x, n = failures, shots
    if x == 0:
        return None, None, beta_quantile(0.975, 1.0, float(n))
    high = 1.0 if x == n else beta_quantile(0.975, float(x), float(n - x)) if state == "target" else beta_quantile(0.975, x + 1.0, float(n - x))
    return x / n, beta_quantile(0.025, float(x), n - x + 1.0), high


def mcnemar(first_only: int, second_only: int) -> float:
    """Two-sided exact binomial test at one half on discordant pairs."""
    n, k = first_only + second_only, min(first_only, second_only)
    if n == 0:
        return 1.0
    tail = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2.0)) for i in range(k + 1))
    return min(1.0, 2.0 * tail)


def intervals(df: DataFrame, failures: str, shots: str, state: str) -> DataFrame:
    """df with estimate, low and high; df has a row for each task, so a Python function an Arrow batch is cheap."""

    @F.pandas_udf("estimate double, low double, high double")
    def limits(x: pd.Series, n: pd.Series, s: pd.Series) -> pd.DataFrame:
        rows = [binomial_interval(*((None if pd.isna(v) else int(v)) for v in (a, b)), c) for a, b, c in zip(x, n, s, strict=True)]
        return pd.DataFrame(rows, columns=["estimate", "low", "high"], dtype="float64")

    return df.withColumn("__i", limits(failures, shots, state)).select(*df.columns, "__i.*")


@F.pandas_udf(DoubleType())
def mcnemar_p(first_only: pd.Series, second_only: pd.Series) -> pd.Series:
    return pd.Series([mcnemar(int(a), int(b)) for a, b in zip(first_only, second_only, strict=True)])


def plan_unbiased(failures: Column, shots: Column, state: Column) -> Column:
    """(r - 1) / (n - 1) at a target stop, else x / n; null where the stop depended on time."""
    return F.when(state == "target", F.when(shots > 1, (failures - 1) / (shots - 1))).when(state.isin("cap", "minimum"), failures / shots)


def with_unscored(failures: Column, scored: Column, unscored: Column) -> Column:
    return F.try_divide(failures + unscored, scored + unscored)


def wilson(failures: Column, shots: Column, z: float = 1.96) -> tuple[Column, Column]:
    p, zz = failures / shots, z * z
    centre = (p + zz / (2.0 * shots)) / (1.0 + zz / shots)
    half = F.sqrt(p * (1.0 - p) / shots + zz / (4.0 * shots * shots)) * F.lit(z) / (1.0 + zz / shots)
    return centre - half, centre + half


def decay_fit(df: DataFrame, keys: list[str], rounds: str, failures: str, shots: str, shared_runs: bool = False) -> DataFrame:
    """(keys, rate, low, high): weighted least squares of log(1 - 2P) on rounds; rows without failures or at one half and above refuse the key."""
    p = F.col(failures) / F.col(shots)
    fine = (F.col(failures) > 0) & (p < 0.5)
    ok = F.when(fine, p)
    rows = df.select(*keys, F.col(rounds).cast("double").alias("x"), F.log1p(-2.0 * ok).alias("y"), (1.0 / (F.pow(2.0 / (2.0 * ok - 1.0), F.lit(2.0)) * ok * (1.0 - ok) / F.col(shots))).alias("w"), fine.alias("fine"))
    s = lambda c: F.sum(c)
    w, x, y = F.col("w"), F.col("x"), F.col("y")
    sums = rows.groupBy(*keys).agg(s(w).alias("sw"), s(w * x).alias("swx"), s(w * y).alias("swy"), s(w * x * x).alias("swxx"), s(w * x * y).alias("swxy"), F.bool_and("fine").alias("all_fine"), F.count_distinct("x").alias("lengths"))
    sums = sums.where("all_fine and lengths > 1")
    below = F.col("swxx") - F.col("swx") * F.col("swx") / F.col("sw")
    line = sums.withColumns({"slope": (F.col("swxy") - F.col("swx") * F.col("swy") / F.col("sw")) / below, "below": below, "centre": F.col("swx") / F.col("sw")})
    if shared_runs:
        spread = rows.join(line.select(*keys, "centre", "below"), keys).groupBy(*keys).agg((F.sum(F.abs(x - F.col("centre")) * F.sqrt(w)) / F.max("below")).alias("sd"))
        line = line.join(spread, keys)
    else:
        line = line.withColumn("sd", 1.0 / F.sqrt("below"))
    rate = lambda v: -F.expm1(v) / 2.0
    return line.select(*keys, rate(F.col("slope")).alias("rate"), F.greatest(rate(F.col("slope") + 1.96 * F.col("sd")), F.lit(0.0)).alias("low"), rate(F.col("slope") - 1.96 * F.col("sd")).alias("high"))


def cluster_bootstrap(df: DataFrame, keys: list[str], stream: str, rounds: str, failed: str, resamples: int = 1000, seed: int = 0) -> DataFrame:
    """(keys, low, high): percentile interval of the decay rate when whole streams are drawn again.

    A key's streams are first reduced to one row each; those rows, a few numbers a stream, are a
    group of bounded size for the generator of that key.
    """
    rows = df.groupBy(*keys, stream).agg(F.array_sort(F.collect_list(F.struct(F.col(rounds).cast("double").alias("r"), F.col(failed).cast("double").alias("f")))).alias("c"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def draw(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(stream)
        x = np.array([c["r"] for c in frame.c.iloc[0]])
        f = np.array([[c["f"] for c in row] for row in frame.c])
        rng = np.random.default_rng(seed)
        counts = np.stack([rng.multinomial(len(f), np.full(len(f), 1.0 / len(f))) for _ in range(resamples)])
        p = np.clip(counts @ f / len(f), 1e-12, 0.5 - 1e-12)
        w = (2 * p - 1) ** 2 / (4 * p * (1 - p))
        y = np.log1p(-2 * p)
        mean = (w * x).sum(1) / w.sum(1)
        slope = (w * (x - mean[:, None]) * y).sum(1) / (w * (x - mean[:, None]) ** 2).sum(1)
        low, high = np.percentile(-np.expm1(slope) / 2, [2.5, 97.5])
        return pd.DataFrame([[*frame[keys].iloc[0], low, high]], columns=[*keys, "low", "high"])

    return rows.groupBy(*keys).applyInPandas(draw, f"{fields}, low double, high double")


def inverse_propensity(bad: Column, rate: Column) -> Column:
    """Bad rows a row, from audited rows drawn at a known rate."""
    return F.sum(F.when(bad, 1.0 / rate).otherwise(0.0)) / F.count("*")


def capacity_share(weak: Column, keep: Column, strong: Column) -> Column:
    """The escalated share at which a tier is just full."""
    return (weak - keep) / (strong - keep)


def offered_load(fraction: Column, rate: Column, commit: Column) -> Column:
    return fraction * rate * commit


def utilisation_wait(load: Column) -> Column:
    """Mean wait, in service times, of a single server with exponential times; null when overloaded."""
    return F.when(load < 1.0, load / (1.0 - load))
