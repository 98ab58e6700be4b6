"""Queue recursions that no window function expresses, one independent partition per (task, seed).

Inside a partition the steps are sequential; between partitions nothing is shared, so each is a
grouped function over the rows of one seed, whose number is the length of a run.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def event_loop(events: list[tuple[int, int, Callable]], until: int | None = None) -> list[tuple[int, int, int]]:
    """Runs (time, priority, action) in the order of time, priority and arrival; an action may return more of them. (time, priority, number) of those that ran."""
    heap, number, ran = [], 0, []
    for t, p, f in events:
        heapq.heappush(heap, (t, p, number, f))
        number += 1
    while heap and (until is None or heap[0][0] <= until):
        t, p, n, f = heapq.heappop(heap)
        ran.append((t, p, n))
        for more in f(t) or ():
            heapq.heappush(heap, (more[0], more[1], number, more[2]))
            number += 1
    return ran


def pool_times(ready: np.ndarray, service: np.ndarray, servers: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of jobs served in order by the first of several servers that is free."""
    free = [0] * servers
    start = np.empty(len(ready), np.int64)
    for k, (r, s) in enumerate(zip(ready.tolist(), service.tolist(), strict=True)):
        start[k] = max(r, heapq.heappop(free))
        heapq.heappush(free, int(start[k]) + s)
    return start, start + service


def credit_times(ready: np.ndarray, service: np.ndarray, propagation: int, credits: int, latency: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, landed) on a wire where frame k also waits for the credit of frame k - credits."""
    start, landed, free = np.empty(len(ready), np.int64), np.empty(len(ready), np.int64), 0
    for k in range(len(ready)):
        begin = max(int(ready[k]), free)
        if k >= credits:
            begin = max(begin, int(landed[k - credits]) + latency)
        free = begin + int(service[k])
        start[k], landed[k] = begin, free + propagation
    return start, landed


def reliable_times(ready: np.ndarray, service: np.ndarray, propagation: int, loss: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(landed, sends) on a lossy wire that goes back to the lost frame; the draws are seeded."""
    rng, free = np.random.default_rng(seed), 0
    landed, sends = np.empty(len(ready), np.int64), np.zeros(len(ready), np.int64)
    k, reach = 0, 0
    while k < len(ready):
        begin = max(int(ready[k]), free)
        free = begin + int(service[k])
        sends[k] += 1
        reach = max(reach, k)
        if rng.random() < loss:
            free += 2 * propagation  # the loss is known a round trip later
            continue
        landed[k] = free + propagation
        k += 1
    return landed, sends


def factory_times(attempts: int, period: int, success: float, capacity: int, takes: np.ndarray, seed: int) -> np.ndarray:
    """When each take is served by a buffer that seeded attempts fill, one a period, up to a capacity."""
    rng = np.random.default_rng(seed)
    made = (np.flatnonzero(rng.random(attempts) < success) + 1) * period
    out, at, held = np.full(len(takes), -1, np.int64), 0, 0
    for k, t in enumerate(takes.tolist()):
        while at < len(made) and made[at] <= t:
            held = min(capacity, held + 1)
            at += 1
        if held:
            held -= 1
            out[k] = t
        elif at < len(made):
            out[k] = made[at]
            at += 1
    return out


def _by_run(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str], f: Callable[[pd.DataFrame], dict[str, np.ndarray]]) -> DataFrame:
    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema) + "".join(f", `{n}` {t}" for n, t in columns.items())

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable")
        return frame.assign(**f(frame))

    return df.groupBy(*keys).applyInPandas(run, fields)


def pool_service(df: DataFrame, keys: list[str], order: list[str], ready: str, service: str, servers: int) -> DataFrame:
    def f(x: pd.DataFrame) -> dict[str, np.ndarray]:
        start, end = pool_times(x[ready].to_numpy(), x[service].to_numpy(), servers)
        return {"start": start, "end": end}

    return _by_run(df, keys, order, {"start": "long", "end": "long"}, f)


def credit_channel(df: DataFrame, keys: list[str], order: list[str], ready: str, service: str, propagation: int, credits: int, latency: int) -> DataFrame:
    def f(x: pd.DataFrame) -> dict[str, np.ndarray]:
        start, landed = credit_times(x[ready].to_numpy(), x[service].to_numpy(), propagation, credits, latency)
        return {"start": start, "landed": landed}

    return _by_run(df, keys, order, {"start": "long", "landed": "long"}, f)


def reliable_channel(df: DataFrame, keys: list[str], order: list[str], ready: str, service: str, propagation: int, loss: float, seed: int) -> DataFrame:
    def f(x: pd.DataFrame) -> dict[str, np.ndarray]:
        own = seed + int(x[keys[0]].iloc[0])
        landed, sends = reliable_times(x[ready].to_numpy(), x[service].to_numpy(), propagation, loss, own)
        return {"landed": landed, "sends": sends}

    return _by_run(df, keys, order, {"landed": "long", "sends": "long"}, f)
