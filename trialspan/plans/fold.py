"""From shots to a sweep: record tables of pieces, fold them, summarise tasks, decide what to run next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspan.functions import estimators as E
from trialspan.functions import scalars as S
from trialspan.operators import aggregates as A
from trialspan.operators import analytic as W
from trialspan.operators import sets
from trialspan.schemas import SHOT_ROLES, Roles
from trialspan.sources import files, scans, sinks


def collected(spark: SparkSession, units: DataFrame, measure: Callable, schema: str) -> DataFrame:
    """A row for each unit (task_id, seed), measured on the workers: measure(frame) -> frame."""
    return units.mapInPandas(lambda frames: map(measure, frames), schema)


def record(spark: SparkSession, experiment: str, shots: DataFrame, task: str, first: int, seeds: int, samples: dict[str, DataFrame] | None = None) -> bool:
    """Writes one piece of a task, its shots and further tables."""
    return sinks.write_piece(spark, experiment, task, first, {"shots.csv": shots} | (samples or {}), {}, seeds)


def unsaved(spark: SparkSession, experiment: str, task: str, start: int, seeds: int) -> DataFrame:
    """(lo, end): the half-open ranges of seeds in [start, start + seeds) that no piece holds."""
    saved = [(first, first + n) for t, first, n, _ in scans.piece_folders(spark, experiment, [task])]
    if not saved:
        return spark.createDataFrame([(start, start + seeds)], "lo long, end long")
    rows = spark.createDataFrame([(task, a, b) for a, b in saved], "task_id string, lo long, end long")
    return sets.interval_gaps(rows, ["task_id"], "lo", "end", F.lit(start).cast("long"), F.lit(start + seeds).cast("long")).select("lo", "end")


def folded_shots(spark: SparkSession, experiment: str, types: dict[str, str], tasks: list[str] | None = None) -> DataFrame:
    """Shots of all pieces in the order of tasks and seeds, typed; a shot that stands twice is refused."""
    rows = scans.typed(scans.piece_rows(spark, scans.piece_folders(spark, experiment, tasks), "shots.csv"), types | {"first_seed": "long"})
    twice = rows.groupBy("task_id", "seed").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"shot {twice[0]['seed']} of {twice[0]['task_id']} stands twice")
    return rows.drop("__path", "__place")


def summary(shots: DataFrame, counts: DataFrame | None = None, roles: Roles = SHOT_ROLES, first_seed: int = 0, target: int = 100, minimum: int = 0, cap: int = 10**9, rounds: F.Column | None = None) -> DataFrame:
    """One wide row for each task: totals by role, the prefix with its state, interval estimates, and nearest percentiles of sampled points."""
    keys = ["task_id", "algorithm"]
    held = Roles(*([c for c in part if c in shots.columns] for part in (roles.means, roles.maxes, roles.sums, roles.true_counts)))
    totals = A.role_totals(shots, keys, held.means, held.maxes, held.sums, held.true_counts)
    if {"strong_service_us", "strong_windows"} <= set(shots.columns):
        service = A.ratio(F.col("strong_service_us"), F.col("strong_windows"), F.lit(float("inf")))
        totals = totals.join(shots.groupBy("task_id").agg(service.alias("strong_service_mean_us")), "task_id", "left")
    stop = W.prefix_stop(shots, "task_id", "seed", F.col("failed"), F.col("scored"), F.col("core_seconds") if "core_seconds" in shots.columns else None, first_seed, target, minimum, cap)
    stop = E.intervals(stop.withColumnRenamed("shots", "prefix_shots").withColumnRenamed("failures", "prefix_failures").withColumnRenamed("scored", "prefix_scored"), "prefix_failures", "prefix_scored", "state")
    stop = stop.withColumn("plan_estimate", E.plan_unbiased(F.col("prefix_failures"), F.col("prefix_scored"), F.col("state")))
    if rounds is not None:
        stop = stop.withColumns({f"{c}_per_round": S.per_round_rate(F.col(c), rounds) for c in ("estimate", "low", "high")})
    out = totals.join(stop, "task_id", "left")
    if counts is not None:
        pct = A.nearest_percentile(A.merged_counts(counts, ["task_id", "name"], "value_us"), ["task_id", "name"], "value_us", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
        wide = pct.groupBy("task_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.struct("p50", "p90", "p99"))))).alias("percentiles"))
        out = out.join(wide, "task_id", "left")
    return out


def fold(spark: SparkSession, experiment: str, out: str, types: dict[str, str], **rules) -> DataFrame:
    """Folds all pieces of an experiment and publishes shots and sweep; the result does not depend on how seeds were split."""
    shots = folded_shots(spark, experiment, types)
    sweep = summary(shots, **rules)
    sinks.publish(spark, {"shots": shots, "sweep": sweep}, out, "sweep")
    sinks.write_manifest(spark, out, {"experiment": experiment, "tasks": files.folders(spark, experiment)})
    return spark.read.parquet(f"{out}/sweep")


def neediest(states: DataFrame) -> str | None:
    """The running task with the fewest shots, the first by name on ties."""
    row = states.where("state = 'running'").agg(F.min_by("task_id", F.struct("shots", "task_id"))).head()
    return row[0]


def run_until_stopped(spark: SparkSession, experiment: str, tasks: list[str], measure: Callable, schema: str, types: dict[str, str], batch: int, target: int, minimum: int, cap: int) -> DataFrame:
    """Collects pieces of the neediest task until all tasks stopped; the states."""
    while True:
        found = scans.piece_folders(spark, experiment, tasks)
        next_seed = {t: 0 for t in tasks} | {t: max(a + n for u, a, n, _ in found if u == t) for t in {f[0] for f in found}}
        states = None
        if found:
            states = W.prefix_stop(folded_shots(spark, experiment, types), "task_id", "seed", F.col("failed"), F.col("scored"), None, 0, target, minimum, cap)
        task = next((t for t in tasks if next_seed[t] == 0), None) or neediest(states)
        if task is None:
            return states
        units = spark.range(next_seed[task], next_seed[task] + batch).select(F.lit(task).alias("task_id"), F.col("id").alias("seed"))
        record(spark, experiment, collected(spark, units, measure, schema), task, next_seed[task], batch)
