"""Window schemes, schedulers and batch laws under names; one's own may be added to each table, or given as functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspan.operators import analytic, windows

Scheme = Callable[..., DataFrame]

#: A scheme turns rows with a round count into a row for each window.
SCHEMES: dict[str, Scheme] = {
    "sliding_flush": windows.sliding_flush,
    "sliding_lookahead": windows.sliding_lookahead,
    "whole_batch": windows.whole_batch,
    "block_ab": windows.block_ab,
    "sandwich": windows.sandwich,
}

#: A scheduler gives the order of waiting jobs from (ready, service, deadline); the last tie goes to the job's own order.
SCHEDULERS: dict[str, Callable[[Column, Column, Column], list[Column]]] = {
    "first_ready": lambda ready, service, deadline: [ready],
    "shortest": lambda ready, service, deadline: [service, ready],
    "earliest_deadline": lambda ready, service, deadline: [deadline, ready],
    "last_ready": lambda ready, service, deadline: [ready.desc()],
}


def laid(df: DataFrame, scheme: str | Scheme, rounds: str, **settings: int) -> DataFrame:
    """Windows of a registered scheme or of a function (df, rounds, **settings)."""
    return (SCHEMES[scheme] if isinstance(scheme, str) else scheme)(df, rounds, **settings)


def scheduled(jobs: DataFrame, keys: list[str], scheduler: str | Callable, ready: Column, service: Column, deadline: Column, order: str) -> DataFrame:
    """jobs with `turn`: the place in which a scheduler takes the waiting jobs of each key."""
    rule = SCHEDULERS[scheduler] if isinstance(scheduler, str) else scheduler
    return analytic.ranked(jobs, keys, [*rule(ready, service, deadline), F.col(order)])
