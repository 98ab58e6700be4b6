"""The whole sweep row of a task: what a report's reader sees first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspan.functions import estimators as E
from trialspan.functions import scalars as S
from trialspan.operators import aggregates as A
from trialspan.schemas import POINTS

# Names of the columns of shot rows by role, and the point that is split by tier.
MEANS = [
    "throughput_windows_per_us", "throughput_rounds_per_us", "load", "sim_wall_seconds", "weak_busy_fraction", "strong_busy_fraction", "weak_offered_load", "strong_offered_load",
    "weak_syndrome_weight_mean", "weak_service_mean_us", "strong_wait_mean_us", "weak_reaction_growth_rate", "strong_reaction_growth_rate", "first_deadline_miss_us",
]
MAXES = ["max_queued_windows", "weak_queue_max", "strong_queue_max", "parallel_processes_needed", "weak_syndrome_weight_max", "strong_wait_max_us", "strong_held_in_units_max", "backlog_peak_rounds"]
SUMS = ["referee_windows_checked", "referee_window_disagreements", "escalated_windows", "executed_rounds", "strong_decoded_rounds", "deadline_missed_windows"]
SPLIT_POINT = "buffer0_ready_to_frame"

_KEYS = ["task_id", "algorithm"]


def _ratio(top: str, bottom: str) -> Column:
    return F.when(F.sum(bottom) != 0, F.sum(top) / F.sum(bottom))


def totals(shots: DataFrame, statuses: list[str] = ()) -> DataFrame:
    """(task_id, algorithm, ...): totals, means over shots, largest of all shots and ratios of sums, of the columns that shots hold."""
    held = set(shots.columns)
    scored, failed = F.coalesce("is_scored", F.lit(False)), F.coalesce("logical_failure", F.lit(False))
    out = {
        "shots": F.count(F.lit(1)), "logical_failures": F.count_if(failed), "scored_shots": F.count_if(scored), "unscored_shots": F.count_if(~scored),
        "logical_error_rate_unscored_as_failures": (F.count_if(failed) + F.count_if(~scored)) / F.count(F.lit(1)),
    }
    if "decoded_windows" in held:
        out["windows_per_shot"] = F.avg("decoded_windows")
    out |= {c: F.avg(c) for c in MEANS if c in held} | {c: F.max(c) for c in MAXES if c in held} | {c: F.sum(c) for c in [*SUMS, *statuses] if c in held}
    if {"strong_service_sum_us", "escalated_windows"} <= held:
        out["strong_service_mean_us"] = _ratio("strong_service_sum_us", "escalated_windows")
    if {"window_period_us", "commit_rounds", "executed_rounds", "escalated_windows"} <= held:
        bound = F.max("window_period_us") / F.max("commit_rounds") * F.sum("executed_rounds") / F.sum("escalated_windows")
        out["strong_service_bound_us"] = F.when(F.sum("escalated_windows") != 0, bound).otherwise(F.lit(float("inf")))
    if {"strong_wait_max_us", "decoded_windows", "escalated_windows"} <= held:
        out["escalated_fraction"] = _ratio("escalated_windows", "decoded_windows")
    for p in POINTS:
        if f"{p}_mean_us" in held:
            out |= {f"{p}_mean_us": F.avg(f"{p}_mean_us"), f"{p}_max_us": F.max(f"{p}_max_us")}
    return shots.groupBy(*_KEYS).agg(*(c.alias(n) for n, c in out.items()))


def latencies(counts: DataFrame, points: list[str], tiers: list[str]) -> DataFrame:
    """(task_id, algorithm, <point>_median_us, <point>_p99_us, and of the split point the same by tier, and its windows) of value counts (task_id, algorithm, point, tier, value_us, count)."""
    asked = {"median": 0.5, "p99": 0.99}
    over = A.nearest_percentile(A.merged_counts(counts, [*_KEYS, "point"], "value_us"), [*_KEYS, "point"], "value_us", asked)
    split = counts.where(F.col("point") == SPLIT_POINT)
    split = A.nearest_percentile(A.merged_counts(split, [*_KEYS, "tier"], "value_us"), [*_KEYS, "tier"], "value_us", asked)
    windows = counts.where(F.col("point") == SPLIT_POINT).groupBy(*_KEYS).agg(F.sum("count").alias("recorded_windows"))
    of = lambda by, name, prefix: [F.max(F.when(F.col(by) == name, F.col(c))).alias(f"{prefix}_{c}_us") for c in asked]
    wide = over.groupBy(*_KEYS).agg(*(c for p in points for c in of("point", p, p)))
    tall = split.groupBy(*_KEYS).agg(*(c for t in tiers for c in of("tier", t, f"{SPLIT_POINT}_{t}")))
    return wide.join(tall, _KEYS, "left").join(windows, _KEYS, "left")


def estimated(prefixes: DataFrame, rounds: Column | None = None, adaptive: bool = False) -> DataFrame:
    """Prefixes (task_id, shots, scored, failures, state) with the estimate, its exact limits, its unbiased form, the same a round, and whether it is above one half; an adaptive task has counts only."""
    named = prefixes.select("task_id", "state", F.col("shots").alias("prefix_shots"), F.col("scored").alias("prefix_scored_shots"), F.col("failures").alias("prefix_failures"))
    if adaptive:
        return named
    found = E.intervals(named, "prefix_failures", "prefix_scored_shots", "state")
    unbiased = F.when(F.col("state") != "running", E.plan_unbiased(F.col("prefix_failures"), F.col("prefix_scored_shots"), F.col("state")))
    names = {"estimate": "logical_error_rate_estimate", "low": "logical_error_rate_low", "high": "logical_error_rate_high"}
    found = found.withColumn("logical_error_rate_plan_unbiased", unbiased).withColumnsRenamed(names)
    if rounds is not None:
        per = {"": "estimate", "_low": "low", "_high": "high"}
        found = found.withColumns({f"logical_error_rate_per_round{x}": S.per_round_rate(F.col(f"logical_error_rate_{y}"), rounds) for x, y in per.items()})
    return found.withColumn("is_shot_rate_above_half", F.col("logical_error_rate_estimate") > 0.5)


def rows(shots: DataFrame, counts: DataFrame | None = None, prefixes: DataFrame | None = None, rounds: Column | None = None, statuses: list[str] = (), tiers: list[str] = ("weak", "strong"), adaptive: bool = False) -> DataFrame:
    """One wide row for each task and algorithm: totals, estimates over its prefix, latencies of pooled windows, misses of the deadline."""
    out = totals(shots, statuses)
    if prefixes is not None:
        out = out.join(estimated(prefixes, rounds, adaptive), "task_id", "left")
    if counts is not None:
        out = out.join(latencies(counts, [p for p in POINTS if f"{p}_mean_us" in shots.columns], list(tiers)), _KEYS, "left")
        if "deadline_missed_windows" in out.columns:
            out = out.withColumn("deadline_missed_fraction", F.when(F.col("recorded_windows") > 0, F.col("deadline_missed_windows") / F.col("recorded_windows")))
        out = out.drop("recorded_windows")
    return out
