"""Streams of rounds: stateful operators whose results equal the batch ones.

State is kept per stream and holds a watermark and what lies beyond it, so it is bounded by how
far rounds run ahead, not by how long the stream is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trialspan.session import fresh_path
from trialspan.sources import files


def table_stream(spark: SparkSession, path: str, files_a_trigger: int = 1) -> DataFrame:
    """A Parquet table, a folder or one file, read file by file."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_a_trigger)
    if files.is_file(spark, path):
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def _run(writer: DataStreamWriter, once: bool) -> None:
    """Runs a stream to its end; a live source, which knows no end, until nothing new is there."""
    if once:
        writer.trigger(availableNow=True).start().awaitTermination()
        return
    run = writer.trigger(processingTime="0 seconds").start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()


def drained(stream: DataFrame, mode: str = "append", path: str | None = None, once: bool = True) -> DataFrame:
    """All that a stream has to give, written to the shared folder in micro-batches and read back."""
    spark, path = stream.sparkSession, path or fresh_path(stream.sparkSession, "stream")
    _run(stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/_state").option("path", f"{path}/rows"), once)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


#: Runs of a log that are merged into one.
FAN = 8


def latest(stream: DataFrame, merge: Callable[[DataFrame | None, DataFrame], DataFrame], mode: str = "update", path: str | None = None, once: bool = True) -> DataFrame:
    """The table that remains when all micro-batches are merged, in whatever groups.

    A log of runs: batch n writes run n, as large as the batch, and whenever FAN runs of one size
    stand in a row they become one run. So a row is written again once for each power of FAN in the number
    of batches, and readers merge at most FAN - 1 runs of each size. Which runs are merged follows from n, so a batch that is given again writes the same
    runs, and a stream started again on the same path goes on.
    """
    spark = stream.sparkSession
    path = path or fresh_path(spark, "latest")

    def put(batch: DataFrame, number: int) -> None:
        if not any(lo <= number <= hi for lo, hi in _runs(spark, path)):
            merge(None, batch).write.mode("overwrite").parquet(f"{path}/run-{number}-{number}")
        size = FAN
        while (number + 1) % size == 0:
            lo, step = number + 1 - size, size // FAN
            if (lo, number) not in _runs(spark, path):
                parts = [spark.read.parquet(f"{path}/run-{k}-{k + step - 1}") for k in range(lo, number + 1, step)]
                merge(None, _together(parts)).write.mode("overwrite").parquet(f"{path}/run-{lo}-{number}")
            for k in range(lo, number + 1, step):
                files.remove(spark, f"{path}/run-{k}-{k + step - 1}")
            size *= FAN

    _run(stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/_state").foreachBatch(put), once)
    whole = [spark.read.parquet(f"{path}/run-{lo}-{hi}") for lo, hi in _runs(spark, path)]
    return merge(None, _together(whole)) if whole else spark.createDataFrame([], stream.schema)


def _together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _runs(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """The finished runs that no longer run holds, in order."""
    found = [tuple(map(int, name.split("-")[1:])) for name in files.folders(spark, path) if name.startswith("run-") and files.exists(spark, f"{path}/{name}/_SUCCESS")]
    return sorted((lo, hi) for lo, hi in found if not any(a <= lo and hi <= b and (a, b) != (lo, hi) for a, b in found))


def upsert(keys: list[str], rank: F.Column) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """A merge that keeps the row of the least rank of each key: late results replace provisional ones."""

    def merge(before: DataFrame | None, batch: DataFrame) -> DataFrame:
        both = batch if before is None else before.unionByName(batch)
        names = [c for c in both.columns if c not in keys]
        return both.groupBy(*keys).agg(F.min_by(F.struct(*names), rank).alias("x")).select(*keys, *(F.col("x")[c].alias(c) for c in names))

    return merge


def added(keys: list[str], sums: list[str]) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """A merge that adds partial sums: the incremental form of a batch aggregate."""

    def merge(before: DataFrame | None, batch: DataFrame) -> DataFrame:
        both = batch if before is None else before.unionByName(batch)
        return both.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))

    return merge


class DoneRounds:
    """A set of done rounds as a watermark and the sparse rest beyond it."""

    def __init__(self, watermark: int = 0, ahead: list[int] | None = None):
        self.watermark, self.ahead = watermark, set(ahead or ())

    def add(self, rounds: list[int]) -> None:
        self.ahead |= {r for r in rounds if r > self.watermark}
        while self.watermark + 1 in self.ahead:
            self.watermark += 1
            self.ahead.discard(self.watermark)


def ready_windows(stream: DataFrame, key: str, index: str, commit: int, buffer: int, last: str | None = None) -> DataFrame:
    """(key, index, commit_lo, commit_hi): windows of the lookahead scheme as soon as all rounds up to their buffer's end are there.

    A stream is sealed by any row that holds its last round in column `last`: once all rounds up
    to it have come, the windows still open fire, the tail cut to that round, and of the
    stream's state only the mark that it is closed is left, so what comes late opens nothing.
    """
    kind = stream.schema[key].dataType.simpleString()
    closed = -1

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark, ahead, end = state.get if state.exists else (0, [], 0)
        rows = []
        if end != closed:
            done = DoneRounds(watermark, ahead)
            for frame in frames:
                done.add(frame[index].dropna().astype(int).tolist())
                if last is not None:
                    end = max([end, *frame[last].dropna().astype(int).tolist()])
            sealed = 0 < end <= done.watermark
            first = max(0, (watermark - buffer) // commit)
            until = -(-end // commit) if sealed else max(0, (done.watermark - buffer) // commit)
            rows = [(name[0], i, i * commit + 1, min((i + 1) * commit, end) if sealed else (i + 1) * commit) for i in range(first, until)]
            state.update((0, [], closed) if sealed else (done.watermark, sorted(done.ahead), end))
        yield pd.DataFrame(rows, columns=[key, "index", "commit_lo", "commit_hi"])

    return stream.select(key, index, *([last] if last else [])).groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, index long, commit_lo long, commit_hi long", "watermark long, ahead array<long>, last long", "append", GroupStateTimeout.NoTimeout)


def assembled(stream: DataFrame, keys: list[str], fragment: str, total: str) -> DataFrame:
    """(keys, have): keys whose fragments have all come, in update mode; the state of a key is the set of its fragments.

    A native aggregate: a fragment that comes twice counts once, and a key that gets a fragment
    after it is whole is given again, so merge the result by key. Give the stream a watermark and
    a time among the keys to let old state go.
    """
    found = stream.groupBy(*keys).agg(F.size(F.collect_set(fragment)).alias("have"), F.max(total).alias("need"))
    return found.where("have >= need").select(*keys, "have")


def adapted(stream: DataFrame, key: str, order: str, gap: str, target: float, threshold: float, step_size: float) -> DataFrame:
    """(key, rows, threshold, escalated) after each micro-batch, whose rows follow those before in order."""
    kind = stream.schema[key].dataType.simpleString()

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        theta, n, up = state.get if state.exists else (threshold, 0, 0)
        for g in pd.concat(frames).sort_values(order)[gap].tolist():
            e = g < theta
            theta, n, up = theta + step_size * (target - e), n + 1, up + e
        state.update((float(theta), int(n), int(up)))
        yield pd.DataFrame([(name[0], n, theta, up)], columns=[key, "rows", "threshold", "escalated"])

    return stream.select(key, order, gap).groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, rows long, threshold double, escalated long", "threshold double, rows long, escalated long", "append", GroupStateTimeout.NoTimeout)


def tumbling(stream: DataFrame, time: str, width: str, late: str, keys: list[str]) -> DataFrame:
    """Counts of event-time windows; rows later than the watermark are dropped and windows behind it leave the state."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def once(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
