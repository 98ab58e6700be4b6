"""Round windows: assigners with commit and buffer ranges, readiness, fragments, absorption.

Rounds count from 1 and ranges are closed. An assigner turns rows with a round count into a row
for each window: index, buffer_lo, commit_lo, commit_hi, buffer_hi. All are closed forms over a
sequence, so no rows are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _long(x: Column | int) -> Column:
    return (F.lit(x) if isinstance(x, int) else x).cast("long")


def _spread(df: DataFrame, count: Column) -> DataFrame:
    """A row for each index 0 .. count - 1."""
    return df.withColumn("index", F.explode(F.sequence(_long(0), _long(count) - 1)))


def _ceil(a: Column, b: int) -> Column:
    return F.ceil(a / b).cast("long")


_NAMES = ("buffer_lo", "commit_lo", "commit_hi", "buffer_hi")


def _ranges(df: DataFrame, buffer_lo: Column, commit_lo: Column, commit_hi: Column, buffer_hi: Column) -> DataFrame:
    return df.withColumns(dict(zip(_NAMES, map(_long, (buffer_lo, commit_lo, commit_hi, buffer_hi)), strict=True)))


def sliding_flush(df: DataFrame, rounds: str, commit: int, buffer: int) -> DataFrame:
    """Windows of commit + buffer rounds as long as commit more remain after one; then one tail over the rest."""
    n, wide, i = F.col(rounds), commit + buffer, F.col("index")
    full = F.greatest(F.floor((n - wide) / commit), F.lit(0)).cast("long")
    out = _spread(df, full + 1)
    tail, lo = i == full, i * commit + 1
    return _ranges(out, lo, lo, F.when(tail, n).otherwise(lo + commit - 1), F.when(tail, n).otherwise(lo + wide - 1))


def sliding_lookahead(df: DataFrame, rounds: str, commit: int, buffer: int) -> DataFrame:
    """Every commit rounds a window that reads buffer rounds on, past the end if need be."""
    n, i = F.col(rounds), F.col("index")
    out = _spread(df, F.greatest(_ceil(n, commit), _long(1)))
    high = F.least((i + 1) * commit, n)
    return _ranges(out, i * commit + 1, i * commit + 1, high, high + buffer)


def whole_batch(df: DataFrame, rounds: str) -> DataFrame:
    return _ranges(df.withColumn("index", _long(0)), F.lit(1), F.lit(1), F.col(rounds), F.col(rounds))


def block_ab(df: DataFrame, rounds: str, d: int) -> DataFrame:
    """Blocks A every 4d rounds that commit d of 3d rounds (the first 2d), and blocks B that fill the 3d between.

    Adds `kind` and `closed`. What remains after an A is its own if at most d rounds, a last B if
    at most 3d, else a B and the next A.
    """
    n, i = F.col(rounds), F.col("index")
    first = F.least(F.lit(2 * d), n)
    # A number k ends at 2d + 4dk; it has a successor if more than 3d rounds are left.
    more = F.greatest(_ceil(n - 2 * d - 3 * d, 4 * d), _long(0))
    end = F.least(F.lit(2 * d) + more * 4 * d, n)
    left = n - end
    terminal = ((left > d) & (left <= 3 * d)).cast("long")
    out = _spread(df, 1 + 2 * more + terminal)
    k = F.floor(i / 2).cast("long")
    is_a = i % 2 == 0
    a_lo = F.when(k == 0, F.lit(1)).otherwise(F.lit(2 * d) + (k - 1) * 4 * d + 3 * d + 1)
    a_hi = F.when(k == 0, first).otherwise(F.least(a_lo + d - 1, n))
    absorbs = (k == more) & (left <= d)
    a_hi = F.when(absorbs, n).otherwise(a_hi)
    a_read = F.when(absorbs, n).otherwise(F.when(k == 0, F.least(F.lit(3 * d), n)).otherwise(F.least(a_hi + d, n)))
    b_lo = F.lit(2 * d) + k * 4 * d + 1
    b_hi = F.least(b_lo + 3 * d - 1, n)
    out = out.withColumns({"kind": F.when(is_a, "A").otherwise("B"), "closed": ~is_a})
    return _ranges(out, F.when(is_a, F.when(k == 0, F.lit(1)).otherwise(a_lo - d)).otherwise(b_lo), F.when(is_a, a_lo).otherwise(b_lo), F.when(is_a, a_hi).otherwise(b_hi), F.when(is_a, a_read).otherwise(b_hi))


def sandwich(df: DataFrame, rounds: str, stride: int, buffer: int) -> DataFrame:
    """Cores every `stride` rounds that read `buffer` on both sides, and a one-round closed seam between two cores. Adds `kind` and `closed`."""
    n, s, b = F.col(rounds), stride, buffer
    wide = s + 2 * b
    cores = F.greatest(_ceil(n - wide, s) + 1, _long(1))
    out = _spread(df, 2 * cores - 1)
    i = F.floor(F.col("index") / 2).cast("long")
    core, last = F.col("index") % 2 == 0, i == cores - 1
    lo = F.when(i == 0, F.lit(1)).otherwise(1 + i * s + b)
    hi = F.when(last, n).otherwise(F.least(b + s - 1 + i * s, n))
    seam = b + s + i * s
    out = out.withColumns({"kind": F.when(core, "core").otherwise("seam"), "closed": ~core})
    return _ranges(out, F.when(core, 1 + i * s).otherwise(seam), F.when(core, lo).otherwise(seam), F.when(core, hi).otherwise(seam), F.when(core, F.least(n, i * s + wide)).otherwise(seam))


def cut_regions(df: DataFrame, keys: list[str], index: str, cut: Column, most: int) -> DataFrame:
    """(keys, region, lo, hi): regions of up to `most` rounds, each ended early after a round with a cut."""
    w = Window.partitionBy(*keys).orderBy(index)
    after = F.coalesce(F.lag(cut.cast("int")).over(w), F.lit(0))
    island = F.sum("__after").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumn("__after", after).withColumn("__island", island)
    place = F.row_number().over(Window.partitionBy(*keys, "__island").orderBy(index)) - 1
    rows = rows.withColumn("__part", F.floor(place / most))
    out = rows.groupBy(*keys, "__island", "__part").agg(F.min(index).alias("lo"), F.max(index).alias("hi"))
    return out.withColumn("region", (F.row_number().over(Window.partitionBy(*keys).orderBy("lo")) - 1).cast("long")).drop("__island", "__part")


def ready(buffer_hi: Column, rounds_local: Column, arrived: Column, closed_tail: Column, successors: Column, next_rounds: Column, memory_rounds: Column, exhausted: Column) -> Column:
    """Whether a window's data is complete: its local rounds, and for what it reads beyond them the successor, memory or a closed end."""
    beyond = buffer_hi - rounds_local
    local = arrived >= F.least(buffer_hi, rounds_local)
    met = (beyond <= 0) | closed_tail | (successors == 0) | (next_rounds >= beyond) | (memory_rounds >= beyond) | exhausted
    return local & met


def by_memory_only(buffer_hi: Column, rounds_local: Column, next_rounds: Column, memory_rounds: Column) -> Column:
    beyond = buffer_hi - rounds_local
    return (beyond > 0) & (next_rounds < beyond) & (memory_rounds >= beyond)


def complete_fragments(df: DataFrame, keys: list[str], fragment: str, total: str, tick: str, packing: int = 0) -> DataFrame:
    """(keys, emitted): rounds of which all fragments are there, when the last came and packing was over."""
    g = df.groupBy(*keys).agg(F.count_distinct(fragment).alias("have"), F.max(total).alias("need"), (F.max(tick) + packing).alias("emitted"))
    return g.where("have >= need").drop("have", "need")


def hold_lifetime(df: DataFrame, keys: list[str], kind: str, tick: str, store: str, releases: list[str]) -> DataFrame:
    """(keys, lifetime): from store to the last release; null while nothing released it."""
    stored = F.min(F.when(F.col(kind) == store, F.col(tick)))
    released = F.max(F.when(F.col(kind).isin(*releases), F.col(tick)))
    return df.groupBy(*keys).agg((released - stored).alias("lifetime")).where("lifetime is null or lifetime >= 0")


def late_results(arrival: Column, done: Column, budget: Column | int, slack: int | None = None, queue: Column | None = None, limit: int | None = None) -> tuple[Column, Column]:
    """(late, rescue): whether the result missed its deadline, and the tick at which a rescue starts, or null."""
    budget = _long(budget)
    rescue = F.lit(None).cast("long")
    if slack is not None:
        at = arrival + F.greatest(budget - slack, _long(0))
        rescue = F.when(done > at, at)
    if limit is not None:
        rescue = F.when(queue >= limit, arrival).otherwise(rescue)
    return done > arrival + budget, rescue


def verdicts(gap: Column, status: Column, threshold: float, key: Column, coin: float) -> dict[str, Column]:
    """Keep or escalate by gap, by status, always, and by a coin seeded by the key."""
    return {
        "by_gap": gap < threshold,
        "by_status": status != "ok",
        "constant": F.lit(True),
        "by_coin": F.pmod(F.crc32(key.cast("string")), F.lit(1000)) < F.lit(int(1000 * coin)),
    }


def absorbed(df: DataFrame, keys: list[str], lo: str, hi: str, escalated: str, reach: int, totals: dict[str, Column]) -> DataFrame:
    """Escalated windows are read again `reach` rounds wider and absorb what they touch; totals are taken anew."""
    wide = df.withColumns({"__lo": F.col(lo) - F.when(F.col(escalated), reach).otherwise(0), "__hi": F.col(hi) + F.when(F.col(escalated), reach).otherwise(0)})
    w = Window.partitionBy(*keys).orderBy("__lo", lo)
    before = F.max("__hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    strong = F.max(F.when(F.col(escalated), F.col("__hi"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    joins = (F.col("__lo") <= strong) | (F.col(escalated) & (F.col("__lo") <= before))
    rows = wide.withColumn("__new", F.coalesce(~joins, F.lit(True)).cast("int")).withColumn("__group", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "__group").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.bool_or(escalated).alias(escalated), *(c.alias(n) for n, c in totals.items())).drop("__group")


def as_if_ended(df: DataFrame, keys: list[str], index: str, checkpoints: list[int], totals: dict[str, Column]) -> DataFrame:
    """The totals had the stream ended at each checkpoint: a row counts for the checkpoints not before it, by explosion."""
    later = F.filter(F.array(*(_long(c) for c in checkpoints)), lambda c: c >= F.col(index))
    return df.withColumn("checkpoint", F.explode(later)).groupBy(*keys, "checkpoint").agg(*(c.alias(n) for n, c in totals.items()))


def answer_chain(df: DataFrame, keys: list[str], order: str, weak: str, strong: str, gap: str, thresholds: list[float]) -> DataFrame:
    """(keys, threshold, escalated, failures): the answers that static thresholds would have kept, all thresholds in one pass."""
    rows = df.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    up = F.col(gap) < F.col("threshold")
    return rows.groupBy(*keys, "threshold").agg(F.count_if(up).alias("escalated"), F.count_if(F.when(up, F.col(strong)).otherwise(F.col(weak))).alias("failures"))


def idle_jobs(df: DataFrame, keys: list[str], index: str, idle: Column, commit: int, charge: bool = True) -> DataFrame:
    """(keys, idle_rounds, jobs): runs of idle rounds, charged as one job per full commit region or dropped."""
    w = Window.partitionBy(*keys).orderBy(index)
    rows = df.where(idle).withColumn("__island", F.col(index) - F.row_number().over(w))
    runs = rows.groupBy(*keys, "__island").agg(F.count("*").alias("n"))
    return runs.groupBy(*keys).agg(F.sum("n").alias("idle_rounds"), F.sum(F.floor(F.col("n") / commit) if charge else F.lit(0)).alias("jobs"))
