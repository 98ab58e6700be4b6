"""Graphs: closures by recursion, topological release, validation, components, peeling decoders."""

from __future__ import annotations

import heapq
from collections.abc import Callable
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspan.session import dismissed, staged


def closure(edges: DataFrame, child: str, parent: str, most: int = 64) -> DataFrame:
    """(child, ancestor, depth): all ancestors with the longest path to each; a cycle is an error.

    Paths double in each round, so the rounds grow with the logarithm of the longest path. Only
    pairs that the last round found or deepened are joined: after round k all depths up to 2^k are
    known, and the first half of a longer path is one that round k found.
    """
    cycle = F.count_if(F.col("child") == F.col("ancestor"))
    base = edges.select(F.col(child).alias("child"), F.col(parent).alias("ancestor")).where("child is not null and ancestor is not null").distinct()
    now, seen = staged(base.withColumn("depth", F.lit(1)), "closure", cycle=cycle)
    for k in range(most):
        if seen["cycle"]:
            raise ValueError("the edges hold a cycle")
        new = now.where(F.col("depth") > 2 ** (k - 1) if k else F.lit(True))
        hop = now.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("up"), F.col("depth").alias("more"))
        longer = new.join(hop, "ancestor").select("child", F.col("up").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        found = now.unionByName(longer).groupBy("child", "ancestor").agg(F.max("depth").alias("depth"))
        before = now
        now, seen = staged(found, "closure", cycle=cycle, new=F.count_if(F.col("depth") > 2**k))
        dismissed(before)
        if not seen["new"] and not seen["cycle"]:
            return now
    raise ValueError("paths are too long")


def cycle_nodes(edges: DataFrame, child: str, parent: str, most: int = 1000) -> DataFrame:
    """(node): the nodes that lie on a cycle.

    Nodes without a way in or without a way out are peeled until none is left, a round for each step of the longest
    path that leads into or out of the cycles. What remains are the cycles and what lies between
    them; of these the nodes that reach themselves are on a cycle, found by doubling paths.
    """
    count = F.count(F.lit(1))
    now, seen = staged(edges.select(F.col(child).alias("a"), F.col(parent).alias("b")).where("a is not null and b is not null").distinct(), "peel", n=count)
    for _ in range(most):
        starts, ends = now.select(F.col("a").alias("b")).distinct(), now.select(F.col("b").alias("a")).distinct()
        after, left = staged(now.join(starts, "b", "left_semi").join(ends, "a", "left_semi").select("a", "b"), "peel", n=count)
        if left["n"] == seen["n"]:
            break
        dismissed(now)
        now, seen = after, left
    else:
        raise ValueError("paths into or out of the cycles are too long")
    reach = new = now
    while seen["n"]:
        hop = reach.select(F.col("a").alias("b"), F.col("b").alias("c"))
        more = new.join(hop, "b").select("a", F.col("c").alias("b")).distinct().join(reach, ["a", "b"], "left_anti")
        new, seen = staged(more, "reach", n=count)
        reach = reach.unionByName(new)
    return reach.where("a = b").select(F.col("a").alias("node")).distinct()


def prior(owned: DataFrame, ancestors: DataFrame, window: str, item: str) -> DataFrame:
    """(window, item): items that a window's ancestors own."""
    return ancestors.select(F.col("child").alias("__w"), F.col("ancestor").alias(window)).join(owned, window).select(F.col("__w").alias(window), item)


def validated(nodes: DataFrame, edges: DataFrame, node: str, child: str, parent: str, cycles: bool = False) -> DataFrame:
    """(problem, node): repeated nodes, references to nodes that are not there, and on demand nodes on a cycle."""
    twice = nodes.groupBy(node).count().where("count > 1").select(F.lit("repeated").alias("problem"), F.col(node).alias("node"))
    named = edges.select(F.explode(F.array(child, parent)).alias("node")).distinct()
    found = twice.unionByName(named.join(nodes.select(F.col(node).alias("node")), "node", "left_anti").select(F.lit("unknown").alias("problem"), "node"))
    return found.unionByName(cycle_nodes(edges, child, parent).select(F.lit("cycle").alias("problem"), "node")) if cycles else found


def release_times(nodes: DataFrame, edges: DataFrame, node: str, cost: str, child: str, parent: str, most: int = 1000) -> DataFrame:
    """(node, start, end): an operation starts when all before it are done; no contention. Levels are relaxed until nothing moves; only nodes that moved push on."""
    count = F.count_if("moved")
    now, seen = staged(nodes.select(F.col(node).alias("node"), F.col(cost).cast("long").alias("cost"), F.lit(0).cast("long").alias("start"), F.lit(True).alias("moved")), "release", moved=count)
    links = edges.select(F.col(child).alias("node"), F.col(parent).alias("before"))
    for _ in range(most):
        if not seen["moved"]:
            return now.select("node", "start", (F.col("start") + F.col("cost")).alias("end"))
        ends = now.where("moved").select(F.col("node").alias("before"), (F.col("start") + F.col("cost")).alias("end"))
        late = links.join(ends, "before").groupBy("node").agg(F.max("end").alias("ready"))
        later = F.coalesce(F.col("ready") > F.col("start"), F.lit(False))
        after = now.join(late, "node", "left").select("node", "cost", F.when(later, F.col("ready")).otherwise(F.col("start")).alias("start"), later.alias("moved"))
        before = now
        now, seen = staged(after, "release", moved=count)
        dismissed(before)
    raise ValueError("the edges hold a cycle or a path that is too long")


def components(edges: DataFrame, a: str, b: str, most: int = 64) -> DataFrame:
    """(node, component): the least node reachable, by alternating large and small stars."""
    state = {"n": F.count(F.lit(1)), "h": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    now, seen = staged(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "stars", **state)
    for _ in range(most):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        after, then = staged(pairs.where("u <> v").distinct(), "stars", **state)
        if then == seen:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        dismissed(now)
        now, seen = after, then
    raise ValueError("the graph did not settle")


def union_find_decode(nodes: int, edges: list[tuple[int, int, float]], marked: set[int], boundary: int | None = None) -> list[int]:
    """Edge numbers of a correction whose ends are the marked nodes.

    Clusters around odd marks grow half an edge of the least weight at a time until each holds an
    even number of marks or the boundary; a spanning forest of the grown edges is then peeled
    from its leaves.
    """
    root, odd, rest = list(range(nodes)), [n in marked for n in range(nodes)], [False] * nodes
    if boundary is not None:
        rest[boundary] = True

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    slack = [float(w) for _, _, w in edges]
    grown = [False] * len(edges)
    while True:
        active = {find(n) for n in range(nodes) if odd[find(n)] and not rest[find(n)]}
        pace = {}
        for k, (a, b, _) in enumerate(edges):
            ra, rb = find(a), find(b)
            speed = (ra in active) + (rb in active)
            if ra != rb and speed:
                pace[k] = speed
        if not active or not pace:
            break
        step = min(slack[k] / s for k, s in pace.items())
        for k, s in pace.items():
            slack[k] -= step * s
            if slack[k] <= 1e-12:
                ra, rb = find(edges[k][0]), find(edges[k][1])
                if ra != rb:
                    grown[k] = True
                    root[rb] = ra
                    odd[ra], rest[ra] = odd[ra] != odd[rb], rest[ra] or rest[rb]
    links: dict[int, list[tuple[int, int]]] = {}
    for k, g in enumerate(grown):
        if g:
            links.setdefault(edges[k][0], []).append((edges[k][1], k))
            links.setdefault(edges[k][1], []).append((edges[k][0], k))
    mark, seen, out = set(marked), set(), []
    for start in ([boundary] if boundary is not None else []) + sorted(links):
        if start in seen or start not in links:
            continue
        seen.add(start)
        order, todo = [], [(start, -1, -1)]
        while todo:
            n, up, k = todo.pop()
            order.append((n, up, k))
            for m, e in links.get(n, ()):
                if m not in seen:
                    seen.add(m)
                    todo.append((m, n, e))
        for n, up, k in reversed(order[1:]):
            if n in mark:
                out.append(k)
                mark ^= {n, up}
    return sorted(out)


Decoder = Callable[[int, list[tuple[int, int, float]], set[int]], list[int]]


#: Windows that are Python objects at a time; the rest of an Arrow batch stays in columns.
DECODED_ROWS = 128


def decoded(windows: DataFrame, key: str, decoder: Decoder = union_find_decode) -> DataFrame:
    """(key, correction): rows (key, nodes, edges, marked) decoded one window at a time by any function of them; a window's graph has a bounded size."""
    schema = f"`{key}` {windows.schema[key].dataType.simpleString()}, correction array<int>"
    rows = DECODED_ROWS

    def run(batches):
        for batch in batches:
            for part in (batch.slice(at, rows) for at in range(0, batch.num_rows, rows)):
                edges = part.column("edges")
                of = dict(zip((f.name for f in edges.type.value_type), edges.flatten().flatten(), strict=True))
                every = zip(*(of[c].to_numpy(zero_copy_only=False).tolist() for c in "abw"), strict=True)
                graphs = zip(part.column("nodes").to_pylist(), edges.value_lengths().to_pylist(), part.column("marked").to_pylist(), strict=True)
                answers = [decoder(int(n), list(islice(every, size)), set(m)) for n, size, m in graphs]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(answers, pa.list_(pa.int32()))], [key, "correction"])

    return windows.select(key, "nodes", "edges", "marked").mapInArrow(run, schema)


def odd_walk_gap(nodes: int, edges: list[tuple[int, int, float, bool]], limit: float = float("inf")) -> float:
    """Least weight of a closed walk that crosses flagged edges an odd number of times: shortest paths in the graph of two sheets."""
    links: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
    for a, b, w, cross in edges:
        for s in (0, 1):
            links.setdefault((a, s), []).append((b, s ^ cross, w))
            links.setdefault((b, s), []).append((a, s ^ cross, w))
    best = limit
    for start in range(nodes):
        dist, todo = {(start, 0): 0.0}, [(0.0, start, 0)]
        while todo:
            d, n, s = heapq.heappop(todo)
            if d >= best or d > dist.get((n, s), np.inf):
                continue
            if (n, s) == (start, 1):
                best = d
                break
            for m, t, w in links.get((n, s), ()):
                if d + w < min(best, dist.get((m, t), np.inf)):
                    dist[m, t] = d + w
                    heapq.heappush(todo, (d + w, m, t))
    return best
