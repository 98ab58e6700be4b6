"""Orders, hand-offs between windows, release conditions, controllers and declared statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(df: DataFrame, *order: str) -> DataFrame:
    """Rows of many files in one order, ties by file and place: a range partitioning and a sort in each part."""
    return df.orderBy(*order)


def out_of_order(df: DataFrame, file: str, place: str, key: list[str]) -> DataFrame:
    """Rows whose key is less than that of the row before them in their file."""
    w = Window.partitionBy(file).orderBy(place)
    now = F.struct(*key)
    return df.withColumn("__before", F.lag(now).over(w)).where(F.col("__before") > now).drop("__before")


def carried(df: DataFrame, keys: list[str], order: str, residual: str) -> DataFrame:
    """Adds `boundary`: the XOR of the residuals of all earlier windows of the chain, which the window takes as input."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("boundary", F.coalesce(F.bit_xor(residual).over(w), F.lit(0).cast("long")))


def boundary_emits(policy: str, provisional: Column, final: Column, differs: Column) -> tuple[Column, Column]:
    """(tick at which a boundary is handed on, whether the successor is redone): eager, held until final, or checked."""
    if policy == "held":
        return F.greatest(provisional, final), F.lit(False)
    if policy == "eager":
        return provisional, F.lit(False)
    if policy == "checked":
        return provisional, differs & (final > provisional)
    raise ValueError(f"no boundary policy {policy}")


def revised(weak: DataFrame, strong: DataFrame, key: list[str], answer: str) -> DataFrame:
    """Weak answers with the strong ones where there are any: `final` and whether it revised the first."""
    s = strong.select(*key, F.col(answer).alias("__strong"), F.lit(True).alias("__has"))
    j = weak.join(s, key, "left")
    has = F.coalesce("__has", F.lit(False))
    return j.select(*key, answer, F.when(has, F.col("__strong")).otherwise(F.col(answer)).alias("final"), (has & ~F.col(answer).eqNullSafe(F.col("__strong"))).alias("revised"))


def last_send(windows: DataFrame, sends: DataFrame, key: list[str], reads: str, at: str, tick: str) -> DataFrame:
    """(key, last_send): the latest tick of the rounds that each window's array of reads names."""
    return windows.select(*key, F.explode(reads).alias(at)).join(sends.select(at, tick), at).groupBy(*key).agg(F.max(tick).alias("last_send"))


def coupled(regions: DataFrame, keys: list[str], index: str, offset: int) -> DataFrame:
    """Regions with the partner at an offset of their index; an equality join."""
    partner = regions.select(*keys, (F.col(index) - offset).alias(index), *(F.col(c).alias(f"partner_{c}") for c in regions.columns if c not in keys))
    return regions.join(partner, [*keys, index])


def split_by_basis(entries: DataFrame, kinds: DataFrame, row: str, column: str, kind: str) -> DataFrame:
    """(kind, row, column): entries of a sparse matrix by the kind of their row; columns without a row in a kind are absent from it."""
    return entries.join(kinds.select(row, kind), row).select(kind, row, column).distinct()


def projected(links: DataFrame, left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Links whose both ends are kept."""
    return links.join(left.select(a).distinct(), a, "left_semi").join(right.select(b).distinct(), b, "left_semi")


def usable(ancestors: DataFrame, commits: DataFrame, stream: str, tick: str, own_only: bool = False) -> DataFrame:
    """(stream, usable): when a stream's outcome may be used: once it has committed, or it and all its ancestors have; null while one has not."""
    own = commits.select(stream, F.col(tick).alias("own"))
    if own_only:
        return own.select(stream, F.col("own").alias("usable"))
    before = ancestors.select(F.col("child").alias(stream), F.col("ancestor").alias("__up")).join(commits.select(F.col(stream).alias("__up"), F.col(tick).alias("up")), "__up", "left")
    worst = before.groupBy(stream).agg(F.max("up").alias("up"), F.count_if(F.col("up").isNull()).alias("open"))
    latest = F.when(F.coalesce("open", F.lit(0)) == 0, F.greatest("own", F.coalesce("up", "own")))
    return own.join(worst, stream, "left").select(stream, latest.alias("usable"))


def pending(windows: DataFrame, commits: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """(key, released): held until both its commit and its stored data are there."""
    return windows.select(key).join(commits, key).join(stored, key).select(key, F.greatest("committed", "stored").alias("released"))


def past_warmup(df: DataFrame, keys: list[str], index: str, tick: str, warmup: int) -> DataFrame:
    """Rows from the first tick at which a key's index is past the warm-up."""
    begin = F.min(F.when(F.col(index) > warmup, F.col(tick))).over(Window.partitionBy(*keys))
    return df.withColumn("__begin", begin).where(F.col(tick) >= F.col("__begin")).drop("__begin")


def with_remainder(done: DataFrame, seen: DataFrame, keys: list[str], status: str) -> DataFrame:
    """Statuses of all windows: those that were final, and the rest as `unread`."""
    rest = seen.join(done.select(*keys), keys, "left_anti").select(*keys).withColumn(status, F.lit("unread"))
    return done.select(*keys, status).unionByName(rest)


def online_controller(df: DataFrame, keys: list[str], order: str, gap: str, bad: str, target: float, threshold: float, step: float, audit_every: int, adjust: float, most_bad: float) -> DataFrame:
    """(keys, threshold, target, audited_bad): two loops in order. The inner moves the threshold to the target rate; every
    audit_every-th kept row is audited, and after each audit the outer moves the target up if the share of bad audits is above most_bad, else down."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(gap).alias("g"), F.col(bad).alias("b"))))
    begin = F.struct(F.lit(float(threshold)).alias("theta"), F.lit(float(target)).alias("target"), F.lit(0).alias("kept"), F.lit(0).alias("audits"), F.lit(0).alias("bad"))

    def move(a: Column, x: Column) -> Column:
        up = x["g"] < a["theta"]
        kept = a["kept"] + (~up).cast("int")
        audited = ~up & (kept % audit_every == 0)
        audits, bad_ = a["audits"] + audited.cast("int"), a["bad"] + (audited & x["b"]).cast("int")
        aim = F.when(audited, F.greatest(F.lit(0.0), F.least(F.lit(1.0), a["target"] + F.when(bad_ > audits * F.lit(most_bad), F.lit(adjust)).otherwise(F.lit(-adjust))))).otherwise(a["target"])
        return F.struct((a["theta"] + F.lit(step) * (a["target"] - up.cast("int"))).alias("theta"), aim.alias("target"), kept.alias("kept"), audits.alias("audits"), bad_.alias("bad"))

    return df.groupBy(*keys).agg(F.aggregate(rows, begin, move).alias("x")).select(*keys, F.col("x.theta").alias("threshold"), F.col("x.target").alias("target"), F.col("x.bad").alias("audited_bad"))


@dataclass(frozen=True)
class Statistic:
    """A declared statistic: kind count, or distribution with sum, count, least and largest."""

    path: str
    name: str
    kind: str
    where: Column | None = None
    value: Column | None = None


def statistics(df: DataFrame, keys: list[str], declared: list[Statistic]) -> DataFrame:
    """(keys, path, statistic, field, value): all declared statistics in one aggregation, as long rows."""
    aggs, rows = [], []
    for k, s in enumerate(declared):
        on = s.where if s.where is not None else F.lit(True)
        fields = {"count": F.count_if(on)} if s.kind == "count" else {"count": F.count(F.when(on, s.value)), "sum": F.sum(F.when(on, s.value)), "minimum": F.min(F.when(on, s.value)), "maximum": F.max(F.when(on, s.value))}
        for field, c in fields.items():
            aggs.append(c.cast("long").alias(f"__{k}_{field}"))
            rows.append(F.struct(F.lit(s.path).alias("path"), F.lit(s.name).alias("statistic"), F.lit(field).alias("field"), F.col(f"__{k}_{field}").alias("value")))
    return df.groupBy(*keys).agg(*aggs).select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*").where("value is not null")
