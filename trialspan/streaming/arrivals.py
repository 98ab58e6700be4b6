"""Tables as streams that arrive in several files, and streams run to their end with what their progress tells."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from trialspan.session import fresh_path
from trialspan.sources import files
from trialspan.streaming.rounds import table_stream

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CHANGES = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
_PARTITIONS = "spark.sql.shuffle.partitions"
#: What a closing row has for its event time: later than any row, so that all timers come due.
THE_END = "2200-01-01"
#: Bytes of a micro-batch beyond which it is more than one file, each written and read by a task of its own.
FILE_BYTES = 8 << 20


def in_files(df: DataFrame, batch: Column, count: int, end: str | None = None) -> DataFrame:
    """df as a stream of `count` micro-batches in turn, of a file each while they are small; batch tells for each row which one, 0 to count - 1.

    Larger ones are as many files as tasks run at once, at most: all the same number, which a trigger takes.
    With end, the name of an event-time column, a last file holds one closing row: THE_END, and null in all other columns.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, "arrivals")
    df.withColumn("__batch", batch.cast("int")).write.partitionBy("__batch").parquet(f"{path}/staged")
    staged = spark.read.schema(StructType([*df.schema.fields, StructField("__batch", IntegerType())])).parquet(f"{path}/staged")
    wide = max(1, min(files.size(spark, f"{path}/staged") // (count * FILE_BYTES), spark.sparkContext.defaultParallelism))
    for k in range(count):  # one after the other, as files are read in the order of their times
        staged.where(F.col("__batch") == k).drop("__batch").coalesce(wide).write.mode("append").parquet(f"{path}/files")
        for _ in range(len(spark.read.schema(df.schema).parquet(f"{path}/files").inputFiles()), (k + 1) * wide):
            spark.createDataFrame([], df.schema).coalesce(1).write.mode("append").parquet(f"{path}/files")
    if end:
        last = [F.lit(THE_END).cast(f.dataType).alias(f.name) if f.name == end else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]
        spark.range(1).coalesce(1).select(*last).write.mode("append").parquet(f"{path}/files")
    return table_stream(spark, f"{path}/files", wide)


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB, which holds more than memory and knows maps and timers.

    Each part of the state is opened and committed in every micro-batch, however few rows it gets, so there are no more parts
    than tasks run at once; a commit writes what changed. A stream that is started again keeps the number it began with.
    """
    parts = min(int(spark.conf.get(_PARTITIONS)), spark.sparkContext.defaultParallelism)
    own = {_PROVIDER: _ROCKS, _CHANGES: "true", _PARTITIONS: str(max(parts, 1))}
    before = {name: spark.conf.get(name, None) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


@dataclass(frozen=True)
class Drained:
    """What a stream gave until its end, and of its progress: micro-batches, rows left in state, rows that came too late."""

    rows: DataFrame
    batches: int
    state_rows: int
    late_rows: int


def drained(stream: DataFrame, mode: str = "append", path: str | None = None) -> Drained:
    """All that a stream has to give, written to the shared folder batch by batch. A stream started again on its path goes on where it was."""
    spark, path = stream.sparkSession, path or fresh_path(stream.sparkSession, "stream")
    with rocks(spark):
        run = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/_state").option("path", f"{path}/rows").trigger(availableNow=True).start()
    run.awaitTermination()
    steps = [p.stateOperators for p in run.recentProgress]
    late = sum(o.numRowsDroppedByWatermark for step in steps for o in step)
    return Drained(spark.read.schema(stream.schema).parquet(f"{path}/rows"), len(steps), sum(o.numRowsTotal for o in steps[-1]) if steps else 0, late)
