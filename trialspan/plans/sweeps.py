"""Sweep definitions: named tasks over a grid of values, with constants and stop rules."""

from __future__ import annotations

import itertools
import zlib
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from trialspan.sources import files

STOPS = ("target", "minimum", "cap")


@dataclass(frozen=True)
class Task:
    task_id: str
    values: dict


@dataclass(frozen=True)
class Sweep:
    """A grid of axes without the points that skip names; all tasks share the constants and stop by the same rules."""

    name: str
    axes: dict[str, list]
    constants: dict = field(default_factory=dict)
    stop: dict[str, int] = field(default_factory=dict)
    skip: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        unknown = [k for k in self.stop if k not in STOPS]
        if unknown:
            raise ValueError(f"unknown stop rules: {unknown}")
        if set(self.axes) & set(self.constants):
            raise ValueError("an axis and a constant have one name")

    def tasks(self) -> list[Task]:
        points = (dict(zip(self.axes, values, strict=True)) for values in itertools.product(*self.axes.values()))
        kept = (p for p in points if not any(all(p.get(k) == v for k, v in s.items()) for s in self.skip))
        return [Task("-".join([self.name, *(f"{k}={v}" for k, v in p.items())]), p | self.constants) for p in kept]

    def rules(self) -> dict[str, int]:
        return {"target": 100, "minimum": 0, "cap": 10**9} | self.stop


def load(spark: SparkSession, path: str) -> Sweep:
    return Sweep(**files.read_json(spark, path))


def table(spark: SparkSession, sweep: Sweep) -> DataFrame:
    """(task_id, a column for each axis and constant)"""
    return spark.createDataFrame(pd.DataFrame([{"task_id": t.task_id} | t.values for t in sweep.tasks()]))


def coin(frame: pd.DataFrame) -> pd.DataFrame:
    """A measure to try sweeps with: each seed of a task fails by a coin of its own."""
    failed = [zlib.crc32(f"{t}:{s}".encode()) % 3 == 0 for t, s in zip(frame["task_id"], frame["seed"], strict=True)]
    return pd.DataFrame({"task_id": frame["task_id"], "algorithm": "coin", "seed": frame["seed"], "failed": failed, "scored": True})
