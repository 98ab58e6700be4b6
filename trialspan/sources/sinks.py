"""Sinks: CSV with the union of columns, whole pieces and folds by rename, manifests, traces, datasets."""

from __future__ import annotations

import json
import platform
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspan.operators.sets import union
from trialspan.schemas import RECORD
from trialspan.sources import files


def write_csv(frames: list[DataFrame], path: str, swept: list[str] = ()) -> bool:
    """All rows under one header, first seen first, swept columns after task_id; nothing is written without rows."""
    rows = union(*frames)
    order = [c for c in ("task_id",) if c in rows.columns] + [c for c in swept if c in rows.columns]
    rows = rows.select(*order, *(c for c in rows.columns if c not in order))
    if rows.isEmpty():
        return False
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("struct", "array", "map") else F.col(f.name) for f in rows.schema]
    rows.select(*flat).write.csv(path, header=True, emptyValue="", nullValue="", mode="errorifexists")
    return True


def write_piece(spark: SparkSession, experiment: str, task: str, first: int, tables: dict[str, DataFrame], facts: dict, seeds: int) -> bool:
    """A piece of so many seeds, built aside and moved in by one rename; False if another writer was first."""
    stage = f"{experiment}/{task}/_stage-{uuid.uuid4().hex}"
    for name, rows in tables.items():
        write_csv([rows], f"{stage}/{name}")
    files.write_text(spark, json.dumps(facts | {"task_id": task, "first_seed": first, "seeds": seeds}, sort_keys=True), f"{stage}/piece.json")
    if files.rename(spark, stage, f"{experiment}/{task}/{first}-{first + seeds - 1}"):
        return True
    files.remove(spark, stage)
    return False


def publish(spark: SparkSession, tables: dict[str, DataFrame], where: str, last: str) -> None:
    """All tables of a fold, written aside and moved in, `last` after all others; a reader that sees it sees a whole fold."""
    stage = f"{where}/_fold-{uuid.uuid4().hex}"
    for name, rows in tables.items():
        rows.write.parquet(f"{stage}/{name}")
    files.remove(spark, f"{where}/{last}")  # from here until the end no reader takes the fold for whole
    for name in [n for n in tables if n != last] + [last]:
        files.remove(spark, f"{where}/{name}")
        files.rename(spark, f"{stage}/{name}", f"{where}/{name}")
    files.remove(spark, stage)


def write_record(tables: dict[str, DataFrame], where: str) -> None:
    """One folder for each additive table of RECORD, partitioned by task; a table of another name, or without its columns, is refused."""
    for name, rows in tables.items():
        if name not in RECORD:
            raise ValueError(f"a record has no table {name}")
        lacks = [c for c in [*RECORD[name].keys, *RECORD[name].counts] if c not in rows.columns]
        if lacks:
            raise ValueError(f"{name} lacks {lacks}")
    for name, rows in tables.items():
        rows.write.partitionBy("task_id").parquet(f"{where}/{name}", mode="overwrite")


def write_manifest(spark: SparkSession, where: str, facts: dict) -> None:
    """The facts of a run, with the versions it ran under and when it was written."""
    stated = {"versions": {"spark": spark.version, "python": platform.python_version()}, "written_at": datetime.now(UTC).isoformat(timespec="seconds")}
    files.write_text(spark, json.dumps(stated | facts, sort_keys=True, indent=1, default=str), f"{where}/run.json")


def write_trace(events: DataFrame, path: str, now: float | None = None) -> None:
    """Events (name, cat, ph, ts, dur, pid, tid, args) as JSON lines in order; spans still open are closed at now.

    If events have a `lane`, a metadata row names each thread by it, before all others.
    """
    if "lane" in events.columns:
        named = events.where("lane is not null").groupBy("pid", "tid").agg(F.min("lane").alias("lane"))
        named = named.select("pid", "tid", F.lit("thread_name").alias("name"), F.lit("M").alias("ph"), F.lit(float("-inf")).alias("ts"), F.create_map(F.lit("name"), F.col("lane")).alias("args"))
        events = events.drop("lane").unionByName(named, allowMissingColumns=True)
    closed = events if now is None else events.withColumn("dur", F.when((F.col("ph") == "X") & F.col("dur").isNull(), F.lit(now) - F.col("ts")).otherwise(F.col("dur")))
    closed = closed.orderBy("ts", "tid", "name").withColumn("ts", F.when(F.col("ph") != "M", F.col("ts")))
    closed.write.json(path, mode="overwrite", ignoreNullFields=True)


def write_lines(df: DataFrame, path: str, order: list[str], line: F.Column) -> None:
    df.orderBy(*order).select(line.cast("string").alias("value")).write.text(path)


def write_trajectory(df: DataFrame, path: str, end: bool = True) -> None:
    """(window_count, threshold_db, event) rows in order, and a last row `end` with what stood then."""
    rows = df.select("window_count", "threshold_db", "event").withColumn("last", F.lit(0))
    if end:
        last = rows.agg(F.max_by(F.struct("window_count", "threshold_db"), "window_count").alias("x")).where("x is not null")
        rows = rows.unionByName(last.select("x.*", F.lit("end").alias("event"), F.lit(1).alias("last")))
    rows.orderBy("window_count", "last").drop("last").write.csv(path, header=True)


def write_dataset(shots: DataFrame, path: str, chunk: int = 1000) -> None:
    """Shots in chunks of consecutive seeds, then a manifest with the hash of each file."""
    spark = shots.sparkSession
    shots.withColumn("chunk", F.floor(F.col("root_seed") / chunk)).repartitionByRange("chunk").sortWithinPartitions("root_seed").write.parquet(f"{path}/chunks")
    found = {r["name"]: r["sha256"] for r in files.hashes(spark, f"{path}/chunks", "*.parquet").collect()}
    files.write_text(spark, json.dumps({"files": found}, sort_keys=True), f"{path}/manifest.json")


def write_workload(operations: DataFrame, path: str) -> None:
    operations.write.json(f"{path}/operations.json")


def append_record(spark: SparkSession, record: dict, path: str) -> None:
    """One JSON record as a file of its own."""
    files.write_text(spark, json.dumps(record, sort_keys=True), f"{path}/{uuid.uuid4().hex}.json")
