"""Pieces, folds and the stop loop: the result does not depend on how seeds were split."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialspan.plans import fold
from trialspan.sources import files, scans, sinks

TYPES = {"seed": "long", "failed": "boolean", "scored": "boolean", "core_seconds": "double", "windows": "long", "strong_windows": "long", "strong_service_us": "double", "reaction_us": "double", "backlog_peak": "long"}


def shots(spark, task, seeds, extra=False):
    rows = []
    for s in seeds:
        r = random.Random(f"{task}{s}")
        rows.append((task, "uf", s, r.random() < 0.2, r.random() < 0.9, r.random(), r.randint(1, 9), r.randint(0, 3), r.random() * 5, r.random() if s % 4 else None, r.randint(0, 50)))
    df = spark.createDataFrame(rows, "task_id string, algorithm string, seed long, failed boolean, scored boolean, core_seconds double, windows long, strong_windows long, strong_service_us double, reaction_us double, backlog_peak long")
    return df.withColumn("more", F.lit(1)) if extra else df


def folded(spark, where, cuts):
    for task in ("a", "b"):
        at = 0
        for n in cuts:
            assert fold.record(spark, where, shots(spark, task, range(at, at + n)), task, at, n)
            at += n
    return fold.fold(spark, where, f"{where}/_fold", TYPES, target=5, minimum=3, cap=25)


def approx(rows):
    return [{k: pytest.approx(v) if isinstance(v, float) else v for k, v in r.asDict().items()} for r in rows]


def test_split_invariance(spark, tmp_path):
    one = folded(spark, f"{tmp_path}/one", [30]).orderBy("task_id").collect()
    many = folded(spark, f"{tmp_path}/many", [7, 1, 12, 10]).orderBy("task_id").collect()
    assert [r.asDict() for r in many] == approx(one) and len(one) == 2
    assert {r.state for r in one} <= {"target", "minimum", "cap"}


def test_first_writer_wins_and_gaps(spark, tmp_path):
    where = f"{tmp_path}/e"
    assert fold.record(spark, where, shots(spark, "a", range(0, 5)), "a", 0, 5)
    assert not fold.record(spark, where, shots(spark, "a", range(0, 5)), "a", 0, 5)
    assert fold.record(spark, where, shots(spark, "a", range(10, 15)), "a", 10, 5)
    assert sorted(map(tuple, fold.unsaved(spark, where, "a", 0, 20).collect())) == [(5, 10), (15, 20)]
    assert scans.piece_folders(spark, where) == [("a", 0, 5, f"{where}/a/0-4"), ("a", 10, 5, f"{where}/a/10-14")]
    assert files.read_json(spark, f"{where}/a/0-4/piece.json")["seeds"] == 5


def test_refusals(spark, tmp_path):
    where = f"{tmp_path}/e"
    fold.record(spark, where, shots(spark, "a", range(0, 5)), "a", 0, 5)
    fold.record(spark, where, shots(spark, "a", range(4, 8)), "a", 5, 4)
    with pytest.raises(ValueError, match="twice"):
        fold.folded_shots(spark, where, TYPES)
    fold.record(spark, where, shots(spark, "a", range(20, 25), extra=True), "a", 20, 5)
    with pytest.raises(ValueError, match="columns"):
        fold.folded_shots(spark, where, TYPES)


def test_columns_of_tasks_are_joined(spark, tmp_path):
    where = f"{tmp_path}/e"
    fold.record(spark, where, shots(spark, "a", range(3)), "a", 0, 3)
    fold.record(spark, where, shots(spark, "b", range(3), extra=True), "b", 0, 3)
    out = fold.folded_shots(spark, where, TYPES)
    assert out.where("more is null").select("task_id").distinct().head()[0] == "a" and out.count() == 6


def test_stop_loop(spark, tmp_path):
    def measure(frame):
        s = frame.seed
        return pd.DataFrame({"task_id": frame.task_id, "algorithm": "uf", "seed": s, "failed": s % 3 == 0, "scored": True})

    schema = "task_id string, algorithm string, seed long, failed boolean, scored boolean"
    out = {r.task_id: r for r in fold.run_until_stopped(spark, f"{tmp_path}/e", ["x", "y"], measure, schema, TYPES, 4, 3, 1, 50).collect()}
    assert {k: (r.shots, r.failures, r.state) for k, r in out.items()} == {"x": (7, 3, "target"), "y": (7, 3, "target")}


def test_typed_cells(spark, tmp_path):
    rows = [("1", "True", "2.5", "x", None), ("2", "False", "3", "1", None)]
    df = scans.typed_by_trial(spark.createDataFrame(rows, "a string, b string, c string, d string, e string"))
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "boolean", "double", "string", "string"]
    assert not sinks.write_csv([df.limit(0)], f"{tmp_path}/none") and not files.exists(spark, f"{tmp_path}/none")


def test_dataset_seal(spark, tmp_path):
    path = f"{tmp_path}/d"
    sinks.write_dataset(spark.range(25).select(F.col("id").alias("root_seed"), F.hex("id").alias("events")), path, 10)
    assert scans.damaged(spark, path).count() == 0 and scans.shot_dataset(spark, path, 7).head()["events"] == "7"
    next((tmp_path / "d/chunks").glob("*.parquet")).unlink()
    assert scans.damaged(spark, path).count() == 1
