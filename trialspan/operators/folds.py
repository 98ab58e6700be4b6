"""Folds along a key in order, with a state handed from row to row: memory is one batch and one state, however long the key.

A true recursion has no parallel form within a key. Rows are dealt by key and sorted within their
partition, so Spark spills the sort as it needs, and a task goes through its keys row by row. Keys are independent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Step = Callable[[tuple, tuple], tuple]


def folded(df: DataFrame, keys: list[str], order: list[str], values: list[str], begin: Callable[[], tuple], step: Step, result: str, end: Callable[[tuple], tuple] | None = None) -> DataFrame:
    """(keys, result): step(state, row's values) from begin() over the rows of each key in order; end turns the last state into the result.

    step and end are small functions of plain Python values; result is their schema as DDL. The
    order must be unique within a key for the fold to be defined.
    """
    names = [f"k{k}" for k in range(len(keys))]
    sort = [f"o{k}" for k in range(len(order))]
    rows = df.select(*(F.col(c).alias(n) for c, n in zip(keys, names, strict=True)), *(F.col(c).alias(n) for c, n in zip(order, sort, strict=True)), *(F.col(c).alias(f"v{k}") for k, c in enumerate(values)))
    rows = rows.repartition(*names).sortWithinPartitions(*names, *sort)
    out = StructType([*(f for f in rows.schema.fields if f.name in names), *StructType.fromDDL(result).fields])
    width, first = len(names), len(names) + len(sort)
    finish = end or (lambda state: state)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, ()
        for frame in frames:
            done = []
            for row in frame.itertuples(index=False, name=None):
                key = tuple(None if x != x else x for x in row[:width])
                if key != now:
                    if now is not None:
                        done.append((*now, *finish(state)))
                    now, state = key, begin()
                state = step(state, row[first:])
            if done:
                yield pd.DataFrame(done, columns=out.names)
        if now is not None:
            yield pd.DataFrame([(*now, *finish(state))], columns=out.names)

    found = rows.mapInPandas(run, out)
    return found.select(*(F.col(n).alias(c) for c, n in zip(keys, names, strict=True)), *out.names[width:])


def adaptive_threshold(df: DataFrame, keys: list[str], order: str, gap: str, target: float, threshold: float, step: float) -> DataFrame:
    """(keys, threshold, escalated) after theta += step * (target - [gap < theta]) in order."""

    def move(state: tuple, row: tuple) -> tuple:
        theta, n = state
        up = row[0] < theta
        return theta + step * (target - up), n + up

    return folded(df, keys, [order], [gap], lambda: (float(threshold), 0), move, "threshold double, escalated long")


def online_controller(df: DataFrame, keys: list[str], order: str, gap: str, bad: str, target: float, threshold: float, step: float, audit_every: int, adjust: float, most_bad: float) -> DataFrame:
    """(keys, threshold, target, audited_bad): an inner loop moves the threshold to the target rate; every audit_every-th kept row is
    audited, and after each audit an outer loop moves the target up if the share of bad audits is above most_bad, else down."""

    def move(state: tuple, row: tuple) -> tuple:
        theta, aim, kept, audits, wrong = state
        up = row[0] < theta
        theta += step * (aim - up)
        kept += not up
        if not up and kept % audit_every == 0:
            audits, wrong = audits + 1, wrong + bool(row[1])
            aim = max(0.0, min(1.0, aim + (adjust if wrong > audits * most_bad else -adjust)))
        return theta, aim, kept, audits, wrong

    return folded(df, keys, [order], [gap, bad], lambda: (float(threshold), float(target), 0, 0, 0), move, "threshold double, target double, audited_bad long", lambda s: (s[0], s[1], s[4]))


def ordered_digest(df: DataFrame, keys: list[str], order: list[str], text: str, separator: str = "|") -> DataFrame:
    """(keys, digest): SHA-256 of the texts of a key in order with the separator between, in hexadecimal digits; texts are hashed as they come, null ones left out."""

    def move(state: tuple, row: tuple) -> tuple:
        digest, some = state
        if row[0] is not None:
            digest.update((separator * some + row[0]).encode())
        return digest, some or row[0] is not None

    return folded(df, keys, order, [text], lambda: (hashlib.sha256(), False), move, "digest string", lambda s: (s[0].hexdigest(),))


def target_steps(df: DataFrame, keys: list[str], order: list[str], value: str, block: int, rise_checks: int, calm_checks: int, margin: float) -> DataFrame:
    """(keys, level): block means move a level down on a sustained rise and up after calm, by the rules of analytic.target_steps; of the means as many are kept as the rules look back."""
    back = max(rise_checks, calm_checks)

    def move(state: tuple, row: tuple) -> tuple:
        n, total, means, level, since = state
        n, total = n + 1, total + row[0]
        if n < block:
            return n, total, means, level, since
        means = (*means[-back:], total / block)
        rises = [b > a for a, b in zip(means[:-1], means[1:], strict=True)][-rise_checks:]
        rise = len(rises) == rise_checks and all(rises) and means[-1] - means[-1 - rise_checks] > margin
        calm = len(means) > calm_checks and means[-1] <= means[-1 - calm_checks]
        up = not rise and since + 1 >= calm_checks and calm
        return 0, 0.0, means, level - rise + up, 0 if rise or up else since + 1

    return folded(df, keys, order, [value], lambda: (0, 0.0, (), 0, 0), move, "level int", lambda s: (s[3],))
