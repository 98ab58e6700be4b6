"""Requests, outcomes and run tables: their joins and their summaries by pool, threshold and seed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspan.functions import estimators as E


def requests_of_pools(requests: DataFrame, lives: DataFrame, pools: DataFrame, run: list[str], pool: str) -> DataFrame:
    """Requests with the decode life of their run and ordinal, of the given pools only."""
    return requests.join(lives.join(pools.select(pool).distinct(), pool, "left_semi"), run)


def outcome_rows(outcomes: DataFrame, windows: DataFrame, verdicts: DataFrame, weights: DataFrame, window: list[str], solve: list[str]) -> DataFrame:
    """Each outcome with its window, its verdict and the verdict's weights; all of them null where there is none."""
    return outcomes.join(windows, window, "left").join(verdicts, window, "left").join(weights, solve, "left")


def pool_summary(totals: DataFrame, keys: list[str], busy: str, load: str, queue: str, windows: str) -> DataFrame:
    """Mean busy fraction and load, the longest queue and all windows of each task and pool."""
    return totals.groupBy(*keys).agg(F.avg(busy).alias("busy_mean"), F.avg(load).alias("load_mean"), F.max(queue).alias("queue_max"), F.sum(windows).alias("windows"))


def frontier(lines: DataFrame, chains: str) -> DataFrame:
    """(threshold_db, shots, failures, escalated_share, estimate, low, high) over the static chains of all lines.

    chains is an array of structs (threshold_db, failures, shots, escalated, windows).
    """
    each = lines.select(F.explode(chains).alias("c")).select("c.*")
    out = each.groupBy("threshold_db").agg(F.sum("shots").alias("shots"), F.sum("failures").alias("failures"), F.try_divide(F.sum("escalated"), F.sum("windows")).alias("escalated_share"))
    return E.intervals(out, F.col("failures"), F.col("shots"), F.lit("cap"))


def seed_means(runs: DataFrame, keys: list[str], shares: list[str], peaks: list[str], counts: list[str]) -> DataFrame:
    """One row for each setting of a run table: shares are means over seeds, peaks the largest, counts sums."""
    aggregates = [F.avg(c).alias(c) for c in shares] + [F.max(c).alias(c) for c in peaks] + [F.sum(c).alias(c) for c in counts]
    return runs.groupBy(*keys).agg(F.count("*").alias("seeds"), *aggregates)


def round_backlog(windows: DataFrame, keys: list[str], buffer: Column, reaction: Column, period: Column) -> DataFrame:
    """Adds the rounds that stand behind each window: its buffer and what arrived while it was decided."""
    return windows.select(*keys, (buffer + reaction / period).alias("backlog_rounds"))


def tick_end_backlog(read: DataFrame, final: DataFrame, keys: list[str], tick: str, index: str) -> DataFrame:
    """(keys, peak): the most rounds read but not final at the end of any tick; rounds count up to the first that is missing."""
    from pyspark.sql import Window

    def run(df: DataFrame, sign: int) -> DataFrame:
        # round i counts once all rounds up to i have come: at the running maximum of their ticks
        w = Window.partitionBy(*keys).orderBy(index)
        x = df.groupBy(*keys, index).agg(F.min(tick).alias(tick)).withColumn("__n", F.row_number().over(w))
        x = x.withColumn("__t", F.max(tick).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return x.where(F.col("__n") == F.col(index)).select(*keys, F.col("__t").alias("t"), F.lit(sign).alias("d"))

    ends = run(read, 1).unionByName(run(final, -1)).groupBy(*keys, "t").agg(F.sum("d").alias("d"))
    level = F.sum("d").over(Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    return ends.withColumn("level", level).groupBy(*keys).agg(F.max("level").alias("peak"))


#: A confidence signal gives the gap of a window from the weights of its answers; own ones may be added.
SIGNALS: dict[str, Callable[[Column, Column], Column]] = {
    "none": lambda first, second: F.lit(None).cast("double"),
    "complementary": lambda first, second: F.abs(second - first).cast("double"),
    "signed": lambda first, second: (second - first).cast("double"),
}


def with_signal(windows: DataFrame, signal: str | Callable[[Column, Column], Column], first: str, second: str) -> DataFrame:
    """windows with their gap by a registered signal or a function of two weights."""
    f = SIGNALS[signal] if isinstance(signal, str) else signal
    return windows.withColumn("gap", f(F.col(first), F.col(second)))


def refereed(answers: DataFrame, keys: list[str], answer: Column, second: Column) -> DataFrame:
    """(keys, checked, disagreed) of answers that a second decoder gave as well."""
    return answers.where(second.isNotNull()).groupBy(*keys).agg(F.count("*").alias("checked"), F.count_if(~answer.eqNullSafe(second)).alias("disagreed"))


def strong_decodes(decodes: DataFrame, keys: list[str], tier: str, strong: list[str], rounds: str, start: str, done: str) -> DataFrame:
    """(keys, windows, rounds, service_ticks) of the committed decodes of the strong tiers; ticks are whole, so the sum is exact."""
    return decodes.where(F.col(tier).isin(strong)).groupBy(*keys).agg(F.count("*").alias("windows"), F.sum(rounds).alias("rounds"), F.sum(F.col(done) - F.col(start)).alias("service_ticks"))
