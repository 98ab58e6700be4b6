"""Measures of one run's ledgers: latency points of windows, loads, links, movements, traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspan.functions.scalars import TICKS_A_MICROSECOND, range_of


def window_points(windows: DataFrame, commits: DataFrame, stages: DataFrame, hops: DataFrame, sends: DataFrame) -> DataFrame:
    """A row for each committed window with its latency points in ticks.

    windows, commits and stages as in schemas; hops (stream_id, window_index, input, landed,
    dd, escalation, answer_send) and sends (stream_id, window_index, first_send, last_send) may
    lack rows, which count as no delay. A window committed by a run takes the stages that name
    the run; its first dispatch is the earliest of stages that were not cancelled, at or after
    release.
    """
    key = ["stream_id", "window_index"]
    w = windows.join(commits, key).where(F.col("t_done").isNotNull())
    s = stages.withColumn("run_sequence", F.explode("run_sequences")).drop("run_sequences")
    rows = w.join(s, ["stream_id", "run_sequence"]).withColumn("released", F.greatest("t_queued", F.coalesce("t_released", "t_queued")))
    live = ~F.coalesce(F.col("cancelled"), F.lit(False))
    held = [c for c in w.columns if c not in key]
    g = rows.groupBy(*key).agg(
        *(F.first(c).alias(c) for c in held), F.first("released").alias("released"),
        F.min(F.when(live & (F.col("dispatch") >= F.col("released")), F.col("dispatch"))).alias("live_dispatch"),
        *(F.max(c).alias(c) for c in ("compute_start", "fetch_end", "algorithm_end", "done", "ready")),
        F.coalesce(F.max("store_read"), F.lit(0)).alias("store_read"), F.coalesce(F.max("backend_queue_wait"), F.lit(0)).alias("backend_queue_wait"),
    )
    g = g.join(hops, key, "left").join(sends, key, "left")
    first = F.coalesce("live_dispatch", "t_dispatch")
    attempt_end = F.when(F.col("t_done") >= F.col("compute_start"), first).otherwise(F.col("t_done"))
    g = g.withColumns({"first_dispatch": first, "attempt_end": attempt_end})
    g = g.withColumns({"hop_input": F.coalesce("input", F.lit(0)), "hop_landed": F.coalesce("landed", "attempt_end")})
    startable = F.when(F.col("ready").isNull(), F.col("compute_start")).otherwise(F.least(F.greatest("ready", "hop_landed"), "compute_start"))
    answered = F.greatest("t_done", "done")
    g = g.withColumns({"startable": startable, "answered": answered})
    g = g.withColumns({"input_final": F.coalesce(F.greatest("t_input_final", "answered"), "answered"), "sent": F.coalesce("answer_send", "accepted")})
    c = F.col
    points = {
        "buffer_fill": c("t_data_complete") - c("t_first_round"),
        "admission_wait": c("t_queued") - c("t_data_complete"),
        "queue_wait": c("first_dispatch") - c("released"),
        "weak_attempt": c("attempt_end") - c("first_dispatch"),
        "dep_block": (c("released") - c("t_queued")) + (c("hop_landed") - c("hop_input") - c("attempt_end")) + (c("startable") - c("hop_landed")) - c("store_read"),
        "store_read_point": c("store_read"),
        "backend_queue_wait_point": c("backend_queue_wait"),
        "input_link_per_window": c("hop_input"),
        "compute_wait": c("compute_start") - c("startable"),
        "fetch": c("fetch_end") - c("compute_start"),
        "algorithm": c("algorithm_end") - c("fetch_end"),
        "release": c("done") - c("algorithm_end"),
        "service": c("done") - c("compute_start"),
        "confidence": F.greatest(F.lit(0), c("t_done") - c("done")),
        "input_check_wait": c("input_final") - c("answered"),
        "selection_wait": c("sent") - c("input_final"),
        "output_link_per_window": c("accepted") - c("sent"),
        "frame_commit": c("committed") - c("accepted"),
        "dd_per_window": F.coalesce("dd", F.lit(0)),
        "escalation_link_per_window": F.coalesce("escalation", F.lit(0)),
        "buffer0_ready_to_frame": c("committed") - c("t_data_complete"),
        "buffer0_first_round_to_frame": c("committed") - c("t_first_round"),
        "qpu_last_round_to_frame": c("committed") - c("last_send"),
        "qpu_first_round_to_frame": c("committed") - c("first_send"),
    }
    return g.select(*key, *(v.cast("long").alias(k.removesuffix("_point")) for k, v in points.items()))


#: The parts that add up to buffer0_ready_to_frame on a serial path.
SERIAL_PARTS = ["admission_wait", "queue_wait", "weak_attempt", "dep_block", "store_read", "input_link_per_window", "compute_wait", "service", "confidence", "input_check_wait", "selection_wait", "output_link_per_window", "frame_commit"]


def point_samples(points: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, name, value_us, count): the multiset of each latency point."""
    long = points.unpivot(keys, names, "name", "ticks").where("ticks is not null")
    return long.groupBy(*keys, "name", (F.col("ticks") / float(TICKS_A_MICROSECOND)).alias("value_us")).agg(F.count("*").alias("count"))


def link_spans(transfers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, hop, span, delay, landed, first_start): a span, not a sum, as transfers overlap."""
    return transfers.groupBy(*keys, "hop").agg((F.max("delivery") - F.min("request")).alias("span"), F.sum("total_delay").alias("delay"), F.max("delivery").alias("landed"), F.min(F.col("delivery") - F.col("total_delay")).alias("first_start"))


def tier_load(usage: DataFrame, keys: list[str], units: str, span: Column) -> DataFrame:
    """(keys, busy_fraction, offered_load) of busy areas over units * span."""
    return usage.groupBy(*keys).agg((F.sum("busy") / (F.max(units) * F.max(span))).alias("busy_fraction"), (F.sum("offered") / F.max(span)).alias("offered_load"))


def chain_need(mean_us: Column, period_us: float) -> tuple[Column, Column]:
    """(load, parallel windows needed) of a serial chain whose parts have these means."""
    load = F.sum(mean_us) / period_us
    return load, F.ceil(2.0 * F.sum(mean_us) / period_us)


def movement_tallies(moves: DataFrame, path: str, kind: str) -> DataFrame:
    """Events, rounds and bits by path, by memory class and in all."""
    return moves.groupingSets([[path], [kind], []], path, kind).agg(F.count("*").alias("events"), F.sum("rounds").alias("rounds"), F.sum("bits").alias("bits"), F.grouping_id().alias("level"))


def conditional_reactions(operations: DataFrame) -> DataFrame:
    """(operation_id, reaction): from the end of what blocked a started operation to its start."""
    ends = operations.select(F.col("operation_id").alias("blocked_by"), F.col("done").alias("blocker_done"))
    return operations.where("started is not null and blocked_by is not null").join(ends, "blocked_by").select("operation_id", (F.col("started") - F.col("blocker_done")).alias("reaction"))


def follow(trace: DataFrame, kind: str, key: str, landed: Column | None = None) -> DataFrame:
    """The events of one window, request, round or operation of a trace, in order of tick, lane and place.

    An event belongs to a key if its argument of that name equals it, if its request starts with
    `key:`, or if its `rounds` argument `op:lo..hi` covers a key `op:index`; events after the
    window landed do not count.
    """
    args = F.col("args")
    equal = F.coalesce(args[kind] == key, F.lit(False))
    prefix = F.coalesce(args["request"].startswith(f"{key}:"), F.lit(False))
    op, _, index = key.partition(":")
    low, high = range_of(F.regexp_extract(args["rounds"], r":(.*)$", 1))
    covers = F.coalesce((F.regexp_extract(args["rounds"], r"^([^:]*):", 1) == op) & (low <= int(index)) & (high >= int(index)), F.lit(False)) if index.isdigit() else F.lit(False)
    found = trace.where(equal | prefix | covers)
    if landed is not None:
        found = found.where(F.col("ts") <= landed)
    out = found.orderBy("ts", "tid", "place")
    if out.isEmpty():
        some = [r[0] for r in trace.select(args[kind]).where(args[kind].isNotNull()).distinct().limit(5).collect()]
        raise ValueError(f"the trace has no {kind} {key}; it has {some}")
    return out


def stage_life(stages: DataFrame, keys: list[str], start: str, end: str, cancelled: Column | None = None) -> DataFrame:
    """(keys, first, last, life): from the first start to the last end of the stages of a run; cancelled ones do not count."""
    live = stages if cancelled is None else stages.where(~F.coalesce(cancelled, F.lit(False)))
    return live.groupBy(*keys).agg(F.min(start).alias("first"), F.max(end).alias("last")).withColumn("life", F.col("last") - F.col("first"))


def path_counts(events: DataFrame) -> DataFrame:
    """Counts by phase and category, distinct requests, and the longest event, the first on ties."""
    longest = F.max_by("name", F.struct(F.coalesce("dur", F.lit(0.0)), -F.col("place")))
    return events.groupBy("ph", "cat").agg(F.count("*").alias("events"), F.count_distinct(F.col("args")["request"]).alias("requests"), longest.alias("longest"))


def capacity_stalls(rounds: DataFrame, keys: list[str], stored: str, released: str, room: int) -> DataFrame:
    """(keys, over): rounds that found a store of `room` places full, from how many were held when each came."""
    marks = rounds.select(*keys, F.explode(F.array(F.struct(F.col(stored).alias("t"), F.lit(1).alias("d")), F.struct(F.col(released).alias("t"), F.lit(-1).alias("d")))).alias("m")).select(*keys, "m.*")
    held = F.sum("d").over(Window.partitionBy(*keys).orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0))
    return marks.withColumn("held", held).where("d = 1").groupBy(*keys).agg(F.count_if(F.col("held") > room).alias("over"))


def unsettled(opened: DataFrame, closed: DataFrame, key: str) -> DataFrame:
    """Keys opened and never closed: nothing may be held or unanswered at the end."""
    return opened.select(key).distinct().join(closed.select(key), key, "left_anti")
