"""The driver's tables as the engine's streams, trials and rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with their tick: microseconds as a long."""
    return table(spark, sf_dir, "events").withColumn("tick", F.unix_micros(F.col("ts").cast("timestamp"))).drop("ts", "props")


#: The same in SQL.
EVENTS = "(select event_id, epoch_us(ts) as tick, user_id, event_type, value from events)"


def day(c: str) -> F.Column:
    return F.unix_date(F.col(c).cast("date"))


def day_sql(c: str) -> str:
    return f"date_diff('day', date '1970-01-01', cast({c} as date))"
