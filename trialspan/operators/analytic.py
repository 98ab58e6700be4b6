"""Order-dependent row computations as window functions. Every order needs a unique tie-break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RUNNING = (Window.unboundedPreceding, 0)


def prefix_stop(df: DataFrame, task: str, seed: str, failed: Column, scored: Column, seconds: Column | None = None, first_seed: int = 0, target: int | None = None, minimum: int = 0, cap: int | None = None, time_cap: float | None = None) -> DataFrame:
    """The contiguous prefix of each task's rows in seed order up to the first row where a rule stops, and its state.

    (task, shots, scored, failures, state): state is target, minimum, cap, time cap, or running.
    Unscored rows do not fail; a missing seed closes the prefix.
    """
    scored = F.coalesce(scored, F.lit(False))
    took = seconds if seconds is not None else F.lit(0.0)
    rows = df.select(F.col(task).alias("__task"), F.col(seed).alias("__seed"), (F.coalesce(failed, F.lit(False)) & scored).cast("int").alias("f"), scored.cast("int").alias("s"), took.alias("t"))
    w = Window.partitionBy("__task").orderBy("__seed")
    run = w.rowsBetween(*_RUNNING)
    rows = rows.withColumn("n", F.row_number().over(w)).where(F.col("__seed") == F.col("n") - 1 + first_seed)
    rows = rows.withColumns({"failures": F.sum("f").over(run), "scored": F.sum("s").over(run), "seconds": F.sum("t").over(run)})
    state = F.lit(None).cast("string")
    if time_cap is not None:
        state = F.when(F.col("seconds") >= time_cap, "time cap").otherwise(state)
    if cap is not None:
        state = F.when(F.col("n") >= cap, "cap").otherwise(state)
    if target is not None:
        state = F.when((F.col("failures") >= target) & (F.col("scored") >= minimum), F.when(F.col("scored") == minimum, "minimum").otherwise("target")).otherwise(state)
    rows = rows.withColumn("state", state)
    stop = F.coalesce(F.min(F.when(F.col("state").isNotNull(), F.col("n"))).over(Window.partitionBy("__task")), F.lit(2**31 - 1))
    kept = rows.withColumn("stop", stop).where("n <= stop")
    last = kept.groupBy("__task").agg(F.max_by(F.struct("n", "scored", "failures", "state"), "n").alias("x"))
    return last.select(F.col("__task").alias(task), F.col("x.n").cast("long").alias("shots"), F.col("x.scored").alias("scored"), F.col("x.failures").alias("failures"), F.coalesce("x.state", F.lit("running")).alias("state"))


def paired_delay(df: DataFrame, keys: list[str], kind: str, tick: str, opened: str, closed: str) -> DataFrame:
    """For each key the ticks from its `opened` row to its last `closed` row; 0 where either is missing."""
    pair = df.groupBy(*keys).agg(F.min(F.when(F.col(kind) == opened, F.col(tick))).alias("a"), F.max(F.when(F.col(kind) == closed, F.col(tick))).alias("b"))
    return pair.select(*keys, F.greatest(F.coalesce(F.col("b") - F.col("a"), F.lit(0)), F.lit(0)).alias("stall"))


def level_summary(df: DataFrame, keys: list[str], tick: str, order: str, level: str, end: Column | None = None, start: Column | None = None) -> DataFrame:
    """(keys, area, span, mean, peak) of a step function that holds the last level set in each tick.

    `end` closes the last level (default: it has no length). `start` restarts area and span at
    a tick with the level it then has.
    """
    last = df.groupBy(*keys, tick).agg(F.max_by(level, order).alias("level"))
    w = Window.partitionBy(*keys).orderBy(tick)
    held = last.withColumn("until", F.lead(tick).over(w))
    until = F.coalesce("until", end if end is not None else F.col(tick))
    begin = F.greatest(F.col(tick), start) if start is not None else F.col(tick)
    held = held.withColumn("held", F.greatest(until - begin, F.lit(0)))
    counts = (F.col("held") > 0) | F.col("until").isNull()
    return held.groupBy(*keys).agg(F.sum(F.col("level") * F.col("held")).alias("area"), F.sum("held").alias("span"), F.max(F.when(counts, F.col("level"))).alias("peak")).withColumn("mean", F.when(F.col("span") > 0, F.col("area") / F.col("span")))


def history(df: DataFrame, keys: list[str], tick: str, order: str, level: str) -> DataFrame:
    """The series of (tick, level) of each key, in order, repeats kept."""
    series = F.array_sort(F.collect_list(F.struct(F.col(tick).alias("t"), F.col(order).alias("o"), F.col(level).alias("v"))))
    return df.groupBy(*keys).agg(F.transform(series, lambda x: F.struct(x["t"].alias("tick"), x["v"].alias("level"))).alias("series"))


def sweep_line_peak(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """The most intervals [start, end) of a key that overlap at the end of a tick."""
    marks = df.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("tick"), F.lit(1).alias("d")), F.struct(F.col(end).alias("tick"), F.lit(-1).alias("d")))).alias("m")).select(*keys, "m.tick", "m.d")
    net = marks.groupBy(*keys, "tick").agg(F.sum("d").alias("d"))
    run = F.sum("d").over(Window.partitionBy(*keys).orderBy("tick").rowsBetween(*_RUNNING))
    return net.withColumn("now", run).groupBy(*keys).agg(F.max("now").alias("peak"))


def unbroken_prefix(df: DataFrame, keys: list[str], index: str, ok: Column, first: int = 1) -> DataFrame:
    """How many indices first, first + 1, ... all hold without a gap."""
    good = df.where(ok).select(*keys, index).distinct()
    w = Window.partitionBy(*keys).orderBy(index)
    run = good.where(F.col(index) >= first).withColumn("n", F.row_number().over(w)).withColumn("island", F.col(index) - F.col("n"))
    return df.select(*keys).distinct().join(run.where(F.col("island") == first - 1).groupBy(*keys).agg(F.count("*").alias("unbroken")), keys, "left").fillna(0, ["unbroken"])


def past_passed(df: DataFrame, keys: list[str], order: str, failed: str) -> DataFrame:
    """Adds `counted`: the row before did not fail, for certain; first rows count and a null failure does not pass."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("counted", (F.row_number().over(w) == 1) | F.coalesce(~F.lag(failed).over(w), F.lit(False)))


def running_difference(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumns({f"{v}_step": F.col(v) - F.lag(v, 1, 0).over(w) for v in values})


def split_at(df: DataFrame, keys: list[str], order: str, value: str, boundary: Column) -> DataFrame:
    """(keys, before, after): the last value up to a boundary, and what the last of all adds."""
    before = F.max_by(value, F.when(F.col(order) <= boundary, F.col(order)))
    return df.groupBy(*keys).agg(F.coalesce(before, F.lit(0)).alias("before"), (F.max_by(value, order) - F.coalesce(before, F.lit(0))).alias("after"))


def count_blocks(df: DataFrame, keys: list[str], order: list[str], size: int, value: Column) -> DataFrame:
    """Means over blocks of so many consecutive rows."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("block", F.floor(n / size)).groupBy(*keys, "block").agg(F.count("*").alias("rows"), F.avg(value).alias("mean"))


def every_kth(df: DataFrame, keys: list[str], order: list[str], k: int, flag: Column) -> DataFrame:
    """Cumulative (rows, flagged) at every k-th row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumns({"rows": F.row_number().over(w).cast("long"), "flagged": F.sum(flag.cast("long")).over(w.rowsBetween(*_RUNNING))})
    return out.where(F.col("rows") % k == 0).select(*keys, "rows", "flagged")


def serial_channel(df: DataFrame, keys: list[str], order: list[str], ready: str, service: str, propagation: int = 0) -> DataFrame:
    """Adds start, end and landed of a first-in first-out wire: the prefix maximum replaces the recursion."""
    w = Window.partitionBy(*keys).orderBy(*order)
    total = F.sum(service).over(w.rowsBetween(*_RUNNING))
    slack = df.withColumn("__sum", total).withColumn("__slack", F.max(F.col(ready) - (F.col("__sum") - F.col(service))).over(w.rowsBetween(*_RUNNING)))
    return slack.withColumn("end", F.col("__sum") + F.col("__slack")).withColumns({"start": F.col("end") - F.col(service), "landed": F.col("end") + propagation}).drop("__sum", "__slack")


def adaptive_threshold(df: DataFrame, keys: list[str], order: str, gap: str, target: float, threshold: float, step: float) -> DataFrame:
    """(keys, threshold, escalated) after theta += step * (target - [gap < theta]) in order: a fold, as each step needs the one before."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(gap).alias("g"))))
    begin = F.struct(F.lit(float(threshold)).alias("theta"), F.lit(0).cast("long").alias("n"))

    def move(a: Column, x: Column) -> Column:
        up = (x["g"] < a["theta"]).cast("long")
        return F.struct((a["theta"] + F.lit(step) * (F.lit(target) - up)).alias("theta"), (a["n"] + up).alias("n"))

    return df.groupBy(*keys).agg(F.aggregate(rows, begin, move).alias("x")).select(*keys, F.col("x.theta").alias("threshold"), F.col("x.n").alias("escalated"))


def target_steps(df: DataFrame, keys: list[str], order: list[str], value: str, block: int, rise_checks: int, calm_checks: int, margin: float) -> DataFrame:
    """(keys, level): block means move a level down on a sustained rise and up after calm.

    At each block mean: if the last rise_checks steps all rise and in all by more than margin,
    the level falls by one; else after calm_checks checks without a fall and a mean no higher than
    that many checks ago, it rises by one and the calm starts anew.
    """
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    means = df.withColumn("block", F.floor(n / block)).groupBy(*keys, "block").agg(F.avg(value).alias("mean"), F.count("*").alias("rows")).where(F.col("rows") == block)
    w = Window.partitionBy(*keys).orderBy("block")
    rises = [F.coalesce(F.lag("mean", k).over(w) > F.lag("mean", k + 1).over(w) if k else F.col("mean") > F.lag("mean").over(w), F.lit(False)) for k in range(rise_checks)]
    rise = rises[0]
    for r in rises[1:]:
        rise = rise & r
    rise = rise & F.coalesce(F.col("mean") - F.lag("mean", rise_checks).over(w) > margin, F.lit(False))
    calm = F.coalesce(F.col("mean") <= F.lag("mean", calm_checks).over(w), F.lit(False))
    flags = means.withColumns({"rise": rise, "calm": calm})
    rows = F.array_sort(F.collect_list(F.struct("block", "rise", "calm")))
    begin = F.struct(F.lit(0).alias("level"), F.lit(0).alias("since"))

    def move(a: Column, x: Column) -> Column:
        up = ~x["rise"] & (a["since"] + 1 >= calm_checks) & x["calm"]
        return F.struct((a["level"] + F.when(x["rise"], -1).when(up, 1).otherwise(0)).alias("level"), F.when(x["rise"] | up, 0).otherwise(a["since"] + 1).alias("since"))

    return flags.groupBy(*keys).agg(F.aggregate(rows, begin, move).alias("x")).select(*keys, F.col("x.level").alias("level"))


def first_dispatch(stages: DataFrame, cancelled: DataFrame, key: str, ordinal: str, dispatch: str, released: str, fallback: str) -> DataFrame:
    """The earliest dispatch at or after release among stages that were not cancelled, else the fallback."""
    live = stages.join(cancelled.select(ordinal), ordinal, "left_anti")
    best = live.groupBy(key).agg(F.min(F.when(F.col(dispatch) >= F.col(released), F.col(dispatch))).alias("best"))
    base = stages.groupBy(key).agg(F.min(fallback).alias("fallback"))
    return base.join(best, key, "left").select(key, F.coalesce("best", "fallback").alias("first_dispatch"))


def ranked(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Adds `turn`: the place in which a scheduler would take the rows of a key."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def best_revision(df: DataFrame, keys: list[str], rank: str, sequence: str) -> DataFrame:
    """Of each key the row of the least rank, the latest among equals."""
    names = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct(F.col(rank), -F.col(sequence))).alias("x")).select(*keys, *(F.col("x")[c].alias(c) for c in names))


def interpolated(df: DataFrame, keys: list[str], x: str, y: str, at: Column) -> DataFrame:
    """(keys, y) at `at` by the first bracketing pair in order of x; keys without one are absent."""
    w = Window.partitionBy(*keys).orderBy(x)
    pair = df.select(*keys, F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1")).where((F.col("x0") <= at) & (at <= F.col("x1")))
    first = pair.groupBy(*keys).agg(F.min_by(F.struct("x0", "y0", "x1", "y1"), "x0").alias("p"))
    share = F.when(F.col("p.x1") > F.col("p.x0"), (at - F.col("p.x0")) / (F.col("p.x1") - F.col("p.x0"))).otherwise(0.0)
    return first.select(*keys, (F.col("p.y0") + share * (F.col("p.y1") - F.col("p.y0"))).alias(y))
