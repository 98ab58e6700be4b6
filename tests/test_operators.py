"""Laws, golden numbers and independent second implementations."""

import heapq
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspan.functions import estimators as E
from trialspan.functions import scalars as S
from trialspan.operators import aggregates as A
from trialspan.operators import analytic as W
from trialspan.operators import graph as G
from trialspan.operators import joins as J
from trialspan.operators import measures as M
from trialspan.operators import sets
from trialspan.operators import simulate as Q
from trialspan.operators import windows as R
from trialspan.sources import scans, sinks
from trialspan.sources.rounds import RoundSource, bits_of
from trialspan.streaming import rounds as T


def test_exact_sum_of_doubles(spark):
    df = spark.createDataFrame([("a", 1e100), ("a", 1.0), ("a", -1e100), ("a", 1.0), ("b", 0.1), ("b", 0.2), ("b", None)], "k string, v double")
    for n in (1, 3):
        assert {r.k: r.exact_sum for r in A.exact_float_sum(df.repartition(n), ["k"], "v").collect()} == {"a": 2.0, "b": math.fsum([0.1, 0.2])}


def test_exact_sum_at_the_ends_of_doubles(spark):
    rng = np.random.default_rng(8)
    values = [1e-19] * 11 + [1e21, 1e300, -1e300, 5e-324, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, -1.7976931348623157e308, 0.0, -0.0]
    values += (rng.standard_normal(500) * 10.0 ** rng.integers(-300, 300, 500)).tolist()
    rows = [("a", v) for v in values] + [("tiny", 5e-324)] * 3 + [("inf", float("inf")), ("inf", 1.0), ("over", 1.7976931348623157e308), ("over", 1.7976931348623157e308), ("none", None)]
    out = {r.k: r.exact_sum for r in A.exact_sum(spark.createDataFrame(rows, "k string, v double").repartition(3), ["k"], "v").collect()}
    assert out.pop("none") is None
    assert out == {"a": math.fsum(values), "tiny": 1.5e-323, "inf": float("inf"), "over": float("inf")}


def test_latest_goes_on_after_a_restart_and_repeats_nothing(spark, tmp_path):
    """Several files, one a batch; a stream that is started again goes on from its last version, and a batch given twice writes the same one."""
    from trialspan.streaming import rounds as T

    source, where = f"{tmp_path}/in", f"{tmp_path}/table"
    put = lambda lo, hi: spark.range(lo, hi).select((F.col("id") % 3).alias("k"), F.lit(1).cast("long").alias("n")).coalesce(1).write.mode("append").parquet(source)
    put(0, 9), put(9, 20)
    stream = lambda: T.table_stream(spark, source)
    first = T.latest(stream(), T.added(["k"], ["n"]), "append", where)
    assert sum(r.n for r in first.collect()) == 20
    put(20, 33)
    assert sum(r.n for r in T.latest(stream(), T.added(["k"], ["n"]), "append", where).collect()) == 33
    commits = sorted((tmp_path / "table/_state/commits").glob("[0-9]*"), key=lambda f: int(f.name))
    commits[-1].with_name(f".{commits[-1].name}.crc").unlink(missing_ok=True)
    commits[-1].unlink()  # as if the run had been killed after its write
    assert sum(r.n for r in T.latest(stream(), T.added(["k"], ["n"]), "append", where).collect()) == 33


def test_streams_carry_state_over_batches(spark, tmp_path):
    from trialspan.streaming import rounds as T

    for part in range(4):  # rounds come out of order over four batches
        spark.createDataFrame([("s", r) for r in range(1, 25) if r % 4 == part], "s string, r long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/rounds")
        spark.createDataFrame([(k, part, 4) for k in range(5) if k < 4 or part < 3], "k long, f long, t long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/parts")
    out = T.drained(T.ready_windows(T.table_stream(spark, f"{tmp_path}/rounds"), "s", "r", 3, 2)).collect()
    assert sorted(r["index"] for r in out) == list(range(7))
    whole = T.latest(T.assembled(T.table_stream(spark, f"{tmp_path}/parts"), ["k"], "f", "t"), T.upsert(["k"], -F.col("have")))
    assert {r.k for r in whole.collect()} == {0, 1, 2, 3}


def test_seal_fires_the_tail_and_lets_state_go(spark, tmp_path):
    from trialspan.streaming import rounds as T

    batches = [[("a", 1, None), ("a", 3, None), ("b", 1, None)], [("a", 2, None), ("a", 5, 8), ("b", 2, 4)], [("a", 4, None), ("a", 6, None), ("a", 7, None), ("a", 8, None), ("b", 4, None)], [("a", 9, None), ("b", 3, None)]]
    for rows in batches:
        spark.createDataFrame(rows, "s string, r long, last long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = T.drained(T.ready_windows(T.table_stream(spark, f"{tmp_path}/in"), "s", "r", 3, 2, "last")).collect()
    assert sorted((r.s, r["index"], r.commit_lo, r.commit_hi) for r in out) == [("a", 0, 1, 3), ("a", 1, 4, 6), ("a", 2, 7, 8), ("b", 0, 1, 3), ("b", 1, 4, 4)]


def test_slots_match_the_recursion(spark):
    from trialspan.operators import devices as D
    from trialspan.operators.simulate import pool_times

    rng = np.random.default_rng(5)
    ready, service = np.sort(rng.integers(0, 500, 60)), rng.integers(1, 40, 60)
    jobs = spark.createDataFrame([(1, k, int(r), int(s)) for k, (r, s) in enumerate(zip(ready, service, strict=True))], "run long, k long, ready long, service long")
    for n in (1, 2, 5):
        out = D.slots(jobs, ["run"], ["ready", "k"], "ready", "service", n).orderBy("k").toPandas()
        start, end = pool_times(ready, service, n)
        assert out.start.tolist() == start.tolist() and out.end.tolist() == end.tolist() and (out.waited == start - ready).all()
    store = D.ported_accesses(jobs, ["run"], ["ready", "k"], "ready", F.col("service"), 8, 3, 2).orderBy("k").toPandas()
    assert store.end.tolist() == pool_times(ready, -(-service // 8) * 3, 2)[1].tolist()


def test_nearest_percentile_is_numpys(spark):
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 6, 11, 100):
        v = rng.integers(0, 40, n).astype(float)
        counts = A.value_counts(spark.createDataFrame([("k", float(x)) for x in v], "k string, v double"), ["k"], "v")
        r = A.nearest_percentile(counts, ["k"], "v", {"a": 0.5, "b": 0.9}).head()
        assert (r.a, r.b) == tuple(np.percentile(v, [50, 90], method="nearest"))


def test_interval_golden():
    est, low, high = E.binomial_interval(16, 400, "cap")
    assert est == 0.04 and low == pytest.approx(0.023033395740548884, abs=1e-14) and high == pytest.approx(0.06414601093905078, abs=1e-14)
    assert E.binomial_interval(0, 10, "cap")[:2] == (None, None) and E.binomial_interval(0, 10, "cap")[2] == pytest.approx(1 - 0.025 ** (1 / 10), abs=1e-12)
    assert E.binomial_interval(5, 5, "cap")[2] == 1.0 and E.binomial_interval(1, 0, "cap") == (None, None, None)
    assert E.binomial_interval(16, 400, "target")[2] < high


def test_interval_coverage():
    n = 30
    for p in (0.05, 0.3, 0.5):
        weight = [math.comb(n, x) * p**x * (1 - p) ** (n - x) for x in range(n + 1)]
        covered = sum(w for x, w in enumerate(weight) if (E.binomial_interval(x, n, "cap")[1] or 0.0) <= p <= E.binomial_interval(x, n, "cap")[2])
        assert covered >= 0.95


def test_mcnemar():
    assert E.mcnemar(0, 0) == 1.0 and E.mcnemar(5, 5) == 1.0 and E.mcnemar(0, 6) == pytest.approx(2 / 64) and E.mcnemar(1, 7) == pytest.approx(2 * 9 / 256)


def test_per_round_rate(spark):
    e, n = 0.01, 20
    shot = (1 - (1 - 2 * e) ** n) / 2
    r = spark.range(1).select(S.per_round_rate(F.lit(shot), F.lit(n)).alias("a"), S.per_round_rate(F.lit(1 - shot), F.lit(n)).alias("b"), S.per_round_rate(F.lit(0.0), F.lit(n)).alias("c")).head()
    assert r.a == pytest.approx(e) and r.b == pytest.approx(1 - e) and r.c == 0.0


@pytest.mark.parametrize("scheme", ["flush", "lookahead", "ab", "sandwich"])
def test_commit_ranges_tile(spark, scheme):
    n = spark.range(1, 80).select(F.col("id").alias("n"))
    for f, b in ((2, 2), (3, 2), (5, 5), (6, 1)):
        out = {"flush": lambda: R.sliding_flush(n, "n", f, b), "lookahead": lambda: R.sliding_lookahead(n, "n", f, b), "ab": lambda: R.block_ab(n, "n", f), "sandwich": lambda: R.sandwich(n, "n", f, b)}[scheme]()
        by: dict[int, list] = {}
        for r in out.collect():
            by.setdefault(r.n, []).append(r)
        assert sorted(by) == list(range(1, 80))
        for k, ws in by.items():
            ws.sort(key=lambda r: r.commit_lo)
            assert ws[0].commit_lo == 1 and ws[-1].commit_hi == k
            assert all(a.commit_hi + 1 == c.commit_lo for a, c in zip(ws, ws[1:], strict=False)), (scheme, f, b, k)
            assert all(r.buffer_lo <= r.commit_lo and r.buffer_hi >= r.commit_hi for r in ws) and sorted(r["index"] for r in ws) == list(range(len(ws)))


def test_sandwich_example(spark):
    out = R.sandwich(spark.createDataFrame([(30,)], "n long"), "n", 5, 2).collect()
    assert len(out) == 11 and [r.commit_lo for r in out if r.kind == "seam"] == [7, 12, 17, 22, 27] and (out[-1].commit_lo, out[-1].commit_hi) == (28, 30)


def test_level(spark):
    rows = [("a", 0, 1, 5), ("a", 10, 2, 9), ("a", 10, 3, 2), ("a", 30, 4, 7)]
    df = spark.createDataFrame(rows, "k string, t long, o long, v long")
    r = W.level_summary(df, ["k"], "t", "o", "v").head()
    assert (r.area, r.span, r.peak) == (5 * 10 + 2 * 20, 30, 7)
    r = W.level_summary(df, ["k"], "t", "o", "v", end=F.lit(40), start=F.lit(20)).head()
    assert (r.area, r.span, r.peak) == (2 * 10 + 7 * 10, 20, 7)


def test_prefix_stop_gap_and_states(spark):
    rows = [("gap", s, False, True) for s in (0, 1, 3)] + [("min", s, s < 3, True) for s in range(9)] + [("target", s, s > 4, True) for s in range(9)] + [("unscored", s, True, s > 7) for s in range(9)]
    out = {r.t: (r.shots, r.scored, r.failures, r.state) for r in W.prefix_stop(spark.createDataFrame(rows, "t string, s long, f boolean, c boolean"), "t", "s", F.col("f"), F.col("c"), target=3, minimum=4, cap=9).collect()}
    assert out == {"gap": (2, 2, 0, "running"), "min": (4, 4, 3, "minimum"), "target": (8, 8, 3, "target"), "unscored": (9, 1, 1, "cap")}


def test_serial_channel_is_the_recursion(spark):
    rng = random.Random(2)
    rows = [("k", i, sorted_t, rng.randint(0, 30)) for i, sorted_t in enumerate(sorted(rng.randint(0, 400) for _ in range(60)))]
    out = W.serial_channel(spark.createDataFrame(rows, "k string, i long, r long, s long"), ["k"], ["i"], "r", "s", 3).orderBy("i").collect()
    free = 0
    for r in out:
        start = max(r.r, free)
        free = start + r.s
        assert (r.start, r.end, r.landed) == (start, free, free + 3)


def test_pool_and_credit():
    rng = np.random.default_rng(4)
    ready, service = np.sort(rng.integers(0, 200, 50)), rng.integers(1, 20, 50)
    start, end = Q.pool_times(ready, service, 3)
    busy = [sum(s <= t < e for s, e in zip(start, end, strict=True)) for t in start]
    assert max(busy) <= 3 and (start >= ready).all()
    one, landed = Q.credit_times(ready, service, 10, 10**6, 0)
    s1, e1 = Q.pool_times(ready, service, 1)
    assert (one == s1).all() and (landed == e1 + 10).all()
    held, landed = Q.credit_times(ready, service, 10, 1, 5)
    assert (held[1:] >= landed[:-1] + 5).all()
    sure, sends = Q.reliable_times(ready, service, 10, 0.0, 1)
    assert (sure == e1 + 10).all() and (sends == 1).all()
    assert (np.diff(Q.reliable_times(ready, service, 10, 0.4, 1)[0]) > 0).all()
    assert Q.event_loop([(5, 0, lambda t: [(t + 1, 0, lambda u: ())]), (5, -1, lambda t: ())]) == [(5, -1, 1), (5, 0, 0), (6, 0, 2)]


def test_union_find_corrects_its_marks():
    rng = random.Random(9)
    for _ in range(60):
        n = rng.randint(3, 9)
        edges = [(a, b, rng.choice([1.0, 2.0, 3.5])) for a in range(n) for b in range(a) if rng.random() < 0.6] + [(k, k + 1, 1.0) for k in range(n - 1)]
        marked = set(rng.sample(range(n), 2 * rng.randint(0, n // 2)))
        ends: dict[int, int] = {}
        for k in G.union_find_decode(n, edges, marked):
            for x in edges[k][:2]:
                ends[x] = ends.get(x, 0) ^ 1
        assert {k for k, v in ends.items() if v} == marked


def test_odd_walk_gap_by_brute_force():
    rng = random.Random(3)
    for _ in range(20):
        n = 5
        edges = [(a, b, float(rng.randint(1, 9)), rng.random() < 0.4) for a in range(n) for b in range(a) if rng.random() < 0.8]
        best = math.inf
        for s in range(n):
            todo, seen = [(0.0, s, 0)], {}
            while todo:
                d, x, p = heapq.heappop(todo)
                if seen.get((x, p), math.inf) <= d:
                    continue
                seen[x, p] = d
                for a, b, w, c in edges:
                    for u, v in ((a, b), (b, a)):
                        if u == x:
                            heapq.heappush(todo, (d + w, v, p ^ c))
            best = min(best, seen.get((s, 1), math.inf))
        assert G.odd_walk_gap(n, edges) == best


def test_graph_errors(spark):
    with pytest.raises(ValueError, match="cycle"):
        G.closure(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "c long, p long"), "c", "p")
    with pytest.raises(ValueError, match="unknown"):
        J.refuse_missing(spark.range(3), spark.range(2), "id")
    with pytest.raises(ValueError, match="repeats"):
        sets.grid(spark, {"a": [1, 1]})


def test_units_and_frames(spark):
    df = spark.createDataFrame([("29ns",), ("0.8us",), ("20dB",), ("3 cycles",), ("x",)], "t string")
    assert [r[0] for r in df.select(S.unit_value(F.col("t"), "time")).collect()] == [29000.0, 800000.0, None, None, None]
    assert [r[0] for r in df.select(S.unit_value(F.col("t"), "cycles")).collect()] == [None, None, None, 3.0, None]
    r = spark.range(1).select(S.frames("pcie", F.lit(8 * 300), payload=256).alias("p"), S.frames("udp", F.lit(8), payload=1500).alias("u"), S.frames("flits", F.lit(0), width=32).alias("f"), S.decibel_bin(F.lit(float("inf"))).alias("i")).head()
    assert r.p == [(256 + 24) * 8, (44 + 24) * 8] and r.u == [(46 + 38) * 8] and r.f == [32] and r.i == math.inf


def test_latency_parts_add_up(spark):
    w = [("s", k, 1, 3, 5, 0, 10 + k, 12 + k, 15 + k, 15 + k, 60 + k, None) for k in range(3)]
    windows = spark.createDataFrame(w, "stream_id string, window_index long, commit_lo long, commit_hi long, buffer_hi long, t_first_round long, t_data_complete long, t_queued long, t_released long, t_dispatch long, t_done long, t_input_final long")
    commits = spark.createDataFrame([("s", k, k, 70 + k, 75 + k) for k in range(3)], "stream_id string, window_index long, run_sequence long, accepted long, committed long")
    st = [("s", [k], "weak", 18 + k, 30 + k, 35 + k, 50 + k, 55 + k, 25 + k, 2, 0, False) for k in range(3)] + [("s", [0, 1], "weak", 16, 20, 21, 22, 23, 19, 0, 0, True)]
    stages = spark.createDataFrame(st, "stream_id string, run_sequences array<long>, tier string, dispatch long, compute_start long, fetch_end long, algorithm_end long, done long, ready long, store_read long, backend_queue_wait long, cancelled boolean")
    hops = spark.createDataFrame([("s", 0, 4, 24, 0, 0, 66)], "stream_id string, window_index long, input long, landed long, dd long, escalation long, answer_send long")
    sends = spark.createDataFrame([("s", 0, 1, 9)], "stream_id string, window_index long, first_send long, last_send long")
    out = M.window_points(windows, commits, stages, hops, sends).orderBy("window_index").collect()
    assert len(out) == 3
    for r in out:
        assert sum(r[p] for p in M.SERIAL_PARTS) == r.buffer0_ready_to_frame
    assert out[0].queue_wait == 3 and out[0].input_link_per_window == 4 and out[1].output_link_per_window == 0 and out[1].qpu_last_round_to_frame is None


def test_trace_round_trip_and_follow(spark, tmp_path):
    events = [{"name": "thread_name", "ph": "M", "pid": 1, "tid": 2, "args": {"name": "decoder"}}]
    events += [{"name": "decode", "cat": "c", "ph": "X", "ts": 5.0 - k, "dur": 1.0 * k, "pid": 1, "tid": 2, "args": {"window": "w1", "request": f"w1:{k}", "rounds": "op1:3..7"}} for k in range(3)]
    (tmp_path / "t.json").write_text(json.dumps(events))
    t = scans.trace(spark, f"{tmp_path}/t.json")
    out = M.follow(t, "window", "w1").collect()
    assert [r.ts for r in out] == [3.0, 4.0, 5.0] and {r.lane for r in out} == {"decoder"}
    assert M.follow(t, "round", "op1:7").count() == 3 and M.path_counts(t).head().longest == "decode"
    with pytest.raises(ValueError, match="no window"):
        M.follow(t, "window", "w9")
    sinks.write_trace(t.drop("lane", "place"), f"{tmp_path}/out", now=9.0)
    back = scans.trace(spark, f"{tmp_path}/out")
    assert back.count() == 3 and sorted(r.ts for r in back.collect()) == [3.0, 4.0, 5.0]


def test_texts(spark, tmp_path):
    (tmp_path / "m.dem").write_text("error(0.1) D0 D3 L0\ndetector(1) D0\nerror(0) D1\nerror(0.2) D1\n")
    assert [(r.ordinal, r.probability, r.detectors, r.observables) for r in scans.error_model(spark, f"{tmp_path}/m.dem").collect()] == [(0, 0.1, [0, 3], [0]), (2, 0.2, [1], [])]
    (tmp_path / "s.lss").write_text("MERGE keep [(0, 1), (2, 3)] 4 [0, 1]\nIDLE free [(5, 6)] 1 []\n")
    rows = scans.schedule(spark, f"{tmp_path}/s.lss").collect()
    assert (rows[0].kind, rows[0].cells, rows[0].duration, rows[0].before) == ("MERGE", [[0, 1], [2, 3]], 4, [0, 1]) and rows[1].before == []
    assert scans.constants("a:\n  b: 3ns  # paper\n  c: 2\nd: x\n") == {"a.b": ("3ns", "paper"), "a.c": ("2", ""), "d": ("x", "")}


def test_round_source_streams_as_it_reads(spark):
    spark.dataSource.register(RoundSource)
    batch = spark.read.format("rounds").options(streams=2, rounds=9, width=5, seed=3).load()
    stream = T.drained(spark.readStream.format("rounds").options(streams=2, rounds=9, width=5, seed=3, step=4).load())
    expected = {(s, k, bits_of(3, s, k, 5)) for s in range(2) for k in range(1, 10)}
    assert {tuple(r) for r in batch.collect()} == expected and {tuple(r) for r in stream.collect()} <= expected
    done = T.DoneRounds()
    for r in (3, 1, 5, 2):
        done.add([r])
    assert done.watermark == 3 and done.ahead == {5}


def test_stream_equals_batch_over_many_files(spark, tmp_path):
    rows = [(s, r) for s in range(3) for r in range(1, 31)]
    random.Random(1).shuffle(rows)
    spark.createDataFrame(rows, "k long, r long").repartition(6).write.parquet(f"{tmp_path}/t")
    got = T.drained(T.ready_windows(T.table_stream(spark, f"{tmp_path}/t"), "k", "r", 4, 3))
    batch = R.sliding_lookahead(spark.createDataFrame([(s, 30) for s in range(3)], "k long, n long"), "n", 4, 3).where("buffer_hi <= n")
    assert {(r.k, r["index"]) for r in got.collect()} == {(r.k, r["index"]) for r in batch.collect()} and got.count() == batch.count()


def test_range_join_makes_each_pair_once(spark):
    rng = random.Random(5)
    points = [(rng.randint(0, 2), rng.randint(-20, 60), i) for i in range(200)]
    ranges = [(rng.randint(0, 2), lo := rng.randint(-20, 60), lo + rng.randint(0, 25), j) for j in range(80)]
    out = J.range_join(spark.createDataFrame(points, "k long, x long, i long"), spark.createDataFrame(ranges, "k long, lo long, hi long, j long"), ["k"], "x", "lo", "hi", 7).select("i", "j").collect()
    expected = sorted((i, j) for k, x, i in points for c, lo, hi, j in ranges if k == c and lo <= x <= hi)
    assert sorted((r.i, r.j) for r in out) == expected


def test_bootstrap_covers(spark):
    rng = np.random.default_rng(0)
    rows = [("k", s, r, bool(rng.random() < (1 - (1 - 0.02) ** r) / 2)) for s in range(400) for r in (5, 10, 20)]
    r = E.cluster_bootstrap(spark.createDataFrame(rows, "k string, s long, r long, f boolean"), ["k"], "s", "r", "f", 300).head()
    assert 0.0 <= r.low < 0.01 < r.high < 0.05


def test_plugins_of_ones_own(spark):
    from trialspan.operators import plugins

    df = spark.createDataFrame([(1, 5), (2, 8)], "id long, n long")
    laid = plugins.laid(df, lambda x, rounds, width: x.withColumn("index", F.expr(f"explode(sequence(0L, ({rounds} - 1) div {width}))")), "n", width=4)
    assert sorted((r.id, r["index"]) for r in laid.collect()) == [(1, 0), (1, 1), (2, 0), (2, 1)]
    turns = plugins.scheduled(df.withColumn("k", F.lit(0)), ["k"], lambda ready, service, deadline: [service.desc()], F.col("n"), F.col("n"), F.col("n"), "id")
    assert {r.id: r.turn for r in turns.collect()} == {2: 1, 1: 2}
    graphs = spark.createDataFrame([(1, 2, [(0, 1, 1.0)], [0, 1])], "id long, nodes int, edges array<struct<a:int,b:int,w:double>>, marked array<int>")
    assert G.decoded(graphs, "id", lambda nodes, edges, marked: sorted(marked)).collect()[0].correction == [0, 1]


def test_nearest_row_at_ties_and_beyond_the_ends(spark):
    cards = spark.createDataFrame([("a", 2.0, 7), ("a", 2.0, 5), ("a", 6.0, 9)], "k string, size double, card long")
    df = spark.createDataFrame([("a", 0.0), ("a", 2.0), ("a", 4.0), ("a", 4.5), ("a", 50.0), ("b", 1.0)], "k string, at double")
    out = {(r.k, r["at"]): r.card for r in J.nearest_row(df, cards, ["k"], "at", "size", "card").collect()}
    assert out == {("a", 0.0): 5, ("a", 2.0): 5, ("a", 4.0): 5, ("a", 4.5): 9, ("a", 50.0): 9, ("b", 1.0): None}
