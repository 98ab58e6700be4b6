"""Devices of a run: slots, ports, fabrics, clocks, frames and timers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspan.operators import analytic, simulate

#: Routes that may be broadcast; beyond them the join is shuffled.
FEW = 100_000


def slots(jobs: DataFrame, keys: list[str], order: list[str], ready: str, service: str, count: int) -> DataFrame:
    """jobs with start, end and waited on a device of `count` slots, first come first served past its capacity.

    One slot is a prefix maximum; with more, each run is served in order by itself.
    """
    served = analytic.serial_channel(jobs, keys, order, ready, service).drop("landed") if count == 1 else simulate.pool_service(jobs, keys, order, ready, service, count)
    return served.withColumn("waited", F.col("start") - F.col(ready))


def ported_accesses(accesses: DataFrame, keys: list[str], order: list[str], at: str, bits: Column, word: int, ticks: int, ports: int) -> DataFrame:
    """accesses with words, start and end on a store whose first free port takes each, `ticks` a word."""
    x = accesses.withColumn("words", F.greatest(F.ceil(bits / word), F.lit(1)).cast("long")).withColumn("__service", F.col("words") * ticks)
    return slots(x, keys, order, at, "__service", ports).drop("__service", "waited")


def fabric_sends(sends: DataFrame, routes: DataFrame, run: list[str], path: str, order: list[str], at: str, bits: str) -> DataFrame:
    """sends with the channel of their path and when they start, end and land on it.

    routes (path, channel, ticks_a_bit, propagation); channels are shared by paths and serve in order.
    """
    routes = F.broadcast(routes) if routes.limit(FEW + 1).count() <= FEW else routes
    x = sends.join(routes, path).withColumn("service", F.ceil(F.col(bits) * F.col("ticks_a_bit")).cast("long"))
    out = analytic.serial_channel(x, [*run, "channel"], order, at, "service")
    return out.withColumn("landed", F.col("end") + F.col("propagation")).drop("ticks_a_bit", "propagation")


def clock_rounds(patches: DataFrame, keys: list[str], start: Column, end: Column, period: Column | int) -> DataFrame:
    """(keys, round, tick): one round a period of each patch while it lives, the first a period after its start."""
    period = F.lit(period) if isinstance(period, int) else period
    n = F.floor((end - start) / period).cast("long")
    x = patches.select(*keys, start.cast("long").alias("__s"), period.cast("long").alias("__p"), n.alias("__n")).where("__n > 0")
    return x.select(*keys, "__s", "__p", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))).alias("round")).select(*keys, "round", (F.col("__s") + F.col("round") * F.col("__p")).alias("tick"))


def frame_commits(corrections: DataFrame, keys: list[str], order: list[str], accepted: str, cost: Column | int) -> DataFrame:
    """corrections with `committed`: after its write, and not before the ones of its frame that were accepted earlier."""
    cost = F.lit(cost) if isinstance(cost, int) else cost
    out = analytic.serial_channel(corrections.withColumn("__cost", cost.cast("long")), keys, order, accepted, "__cost")
    return out.withColumnRenamed("end", "committed").drop("start", "landed", "__cost")


def fired(timers: DataFrame, cancels: DataFrame, key: str, due: str, at: str) -> DataFrame:
    """Timers that nobody cancelled before they were due."""
    first = cancels.groupBy(key).agg(F.min(at).alias("__at"))
    return timers.join(first, key, "left").where(F.col("__at").isNull() | (F.col("__at") >= F.col(due))).drop("__at")
