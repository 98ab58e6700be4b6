"""Streams over several files: state carried from batch to batch, restarts, timers, late rows, the log of runs, the record sink."""

import os
import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from trialspan.operators import windows as R
from trialspan.plans import catalogue
from trialspan.sources import files
from trialspan.sources.rounds import RoundSource, bits_of
from trialspan.streaming import arrivals, records, stateful
from trialspan.streaming import rounds as T

OPS = "k string, tick long, place int, op string, holder string, other string, rounds array<long>"


def put(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def held(ops):
    """The same store as plain dictionaries."""
    stored, holders, out = {}, {}, []

    def settle(r, tick):
        if not any(r in names for names in holders.values()) and r in stored:
            out.append((r, stored.pop(r), tick))

    for _, tick, _, op, holder, other, names in sorted(ops, key=lambda o: o[1:3]):
        if op == "store":
            stored[names[0]] = tick
        elif op == "register":
            holders[holder] = set(names)
        elif op == "replace":
            before, holders[holder] = holders[holder], set(names)
            for r in before - set(names):
                settle(r, tick)
        elif op == "transfer":
            holders[other] = holders.pop(holder)
        elif op == "release":
            for r in holders.pop(holder, ()):
                settle(r, tick)
        elif op == "drop":
            settle(names[0], tick)
    return out, stored


def some_ops(seed):
    rng, ops, live, tick = random.Random(seed), [], [], 0
    for r in range(40):
        tick += 1
        ops.append(("a", tick, 0, "store", None, None, [r]))
        if r % 3 == 0:
            ops.append(("a", tick, 1, "register", f"w{r}", None, list(range(r, r + rng.randint(1, 6)))))
            live.append(f"w{r}")
        if live and rng.random() < 0.3:
            x = live.pop(rng.randrange(len(live)))
            ops.append(("a", tick, 2, "transfer", x, x + "s", None))
            live.append(x + "s")
        if live and rng.random() < 0.3:
            x = rng.choice(live)
            ops.append(("a", tick, 3, "replace", x, None, [r, r + 2]))
        if live and rng.random() < 0.4:
            ops.append(("a", tick, 4, "release", live.pop(0), None, None))
        if rng.random() < 0.3:
            ops.append(("a", tick, 5, "drop", None, None, [rng.randrange(r + 1)]))
    for x in live:
        tick += 1
        ops.append(("a", tick, 0, "release", x, None, None))
    for r in range(40):
        tick += 1
        ops.append(("a", tick, 0, "drop", None, None, [r]))
    return ops + [("a", tick + 1, 0, "release", "nobody", None, None)]


def test_holds_over_restarts_leave_no_state(spark, tmp_path):
    """A micro-batch a file, and the query is stopped and started again after each."""
    ops = some_ops(3)
    expected, left = held(ops)
    assert len(expected) == 40 and not left
    for k in range(4):
        last = max(o[1] for o in ops) + 1
        part = [o for o in ops if o[1] * 4 // last == k]
        put(spark, part, OPS, f"{tmp_path}/ops")
        found = arrivals.drained(stateful.round_holds(T.table_stream(spark, f"{tmp_path}/ops"), "k"), path=f"{tmp_path}/out")
        assert (found.state_rows == 0) == (k == 3)
    assert sorted((r.round, r.stored, r.freed) for r in found.rows.collect()) == sorted(expected)


def test_lifetimes_are_closed_by_the_watermark(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    kind = F.when(F.col("event_type") == "view", 0).when(F.col("event_type").isin("purchase", "click"), 1).otherwise(2)
    batch = R.hold_lifetime(e.withColumn("tick", F.unix_micros("ts")), ["user_id"], "event_type", "tick", "view", ["purchase", "click"])
    e = e.select("user_id", "ts", "event_type", "event_id")
    for split, end in ((F.col("event_id") % 3, "ts"), (F.hash("event_id") % 2 + 1, None)):
        out = arrivals.drained(stateful.hold_lifetimes(arrivals.in_files(e, split, 3, end), "user_id", kind, "ts", 365 * 86_400_000, "365 days"))
        if end:
            assert sorted(map(tuple, out.rows.collect())) == sorted(map(tuple, batch.collect())) and out.state_rows == 0 and out.batches >= 4
        else:  # nothing says that the stream has ended
            assert out.rows.count() == 0 and out.state_rows > 0


def stamp(c):
    return F.timestamp_seconds(c)


def test_timers_cancelled_set_anew_and_late(spark, tmp_path):
    sets = [("a", 100, 200), ("b", 100, 200), ("c", 150, 250), ("d", 150, 250), ("e", 100, 200), ("e", 160, 400), ("f", 300, 350)]
    cancels = [("b", 199), ("c", 250), ("d", 90), ("e", 300), ("x", 120), ("f", 351)]
    t = spark.createDataFrame(sets, "k string, made long, due long").select("k", stamp("made").alias("made"), stamp("due").alias("due"))
    c = spark.createDataFrame(cancels, "k string, at long").select("k", stamp("at").alias("at"))
    slices = lambda x: F.floor(F.unix_seconds(x) / 130)
    made, ended = arrivals.in_files(t, slices("made"), 3, "made"), arrivals.in_files(c, slices("at"), 3, "at")
    out = arrivals.drained(stateful.fired_timers(made, ended, "k", "made", "due", "at", "1 second", 1_000_000))
    assert sorted((r.k, int(r.due.timestamp())) for r in out.rows.collect()) == [("a", 200), ("c", 250), ("f", 350)]
    assert out.state_rows == 0


def regions(rows, most):
    out, run = [], []
    for r, cut in sorted(rows):
        run.append(r)
        if cut or len(run) == most:
            out.append((run[0], run[-1]))
            run = []
    return out + ([(run[0], run[-1])] if run else [])


@pytest.mark.parametrize("seed", range(3))
def test_regions_grow_the_same_for_any_split(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = {k: [(r, rng.random() < 0.25) for r in range(rng.randint(1, 25))] for k in "abc"}
    every = [(k, r, cut) for k, x in rows.items() for r, cut in x]
    rng.shuffle(every)
    every += every[:5]  # some come twice
    for k in range(4):
        put(spark, every[k::4], "k string, r long, cut boolean", f"{tmp_path}/in")
    laid = stateful.growing_regions(T.table_stream(spark, f"{tmp_path}/in"), "k", "r", F.col("cut"), 4)
    got = defaultdict(list)
    with arrivals.rocks(spark):
        for r in T.latest(laid, T.upsert(["k", "region"], -F.col("hi")), "append").orderBy("k", "region").collect():
            got[r.k].append((r.lo, r.hi))
    assert got == {k: regions(x, 4) for k, x in rows.items()}


def test_pending_windows_join_facts_and_late_rows_are_counted(spark, tmp_path):
    w = spark.createDataFrame([(1, 100), (2, 100), (3, 1000), (4, 2000)], "k long, begun long").select("k", stamp("begun").alias("begun"))
    f = [(1, 150, "c", 7), (1, 160, "s", 9), (2, 100 + 3601, "c", 1), (3, 1100, "c", 5), (1, 2, "c", 99), (4, 2000, "s", 3)]
    f = spark.createDataFrame(f, "k long, at long, kind string, value long").select("k", stamp("at").alias("at"), "kind", "value")
    late = spark.createDataFrame([(3, 1, "s", 8, 2)], "k long, at long, kind string, value long, file int").select("k", stamp("at").alias("at"), "kind", "value", "file")
    facts = arrivals.in_files(f.withColumn("file", F.when(F.col("at") > stamp(F.lit(1500)), 1).otherwise(0)).unionByName(late), F.col("file"), 3, "at").drop("file")
    windows = arrivals.in_files(w, F.when(F.col("begun") > stamp(F.lit(500)), 1).otherwise(0), 3, "begun")
    out = arrivals.drained(stateful.pending_releases(windows, facts, "k", "begun", "at", "value", "kind", "1 hour", "10 seconds", "0 seconds"))
    rows = sorted(map(tuple, out.rows.where("k is not null").collect()), key=str)
    assert rows == sorted([(1, "c", 7), (1, "s", 9), (2, None, None), (3, "c", 5), (4, "s", 3)], key=str)
    assert out.late_rows == 1


def test_a_log_of_runs_costs_what_its_batches_are(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "FAN", 3)
    for k in range(11):
        put(spark, [(x, 1) for x in range(k, k + 3)], "k long, n long", f"{tmp_path}/in")
        total = T.latest(T.table_stream(spark, f"{tmp_path}/in"), T.added(["k"], ["n"]), "append", f"{tmp_path}/log")
        assert T._runs(spark, f"{tmp_path}/log") == {0: [(0, 0)], 2: [(0, 2)], 7: [(0, 2), (3, 5), (6, 6), (7, 7)], 8: [(0, 8)], 10: [(0, 8), (9, 9), (10, 10)]}.get(k, T._runs(spark, f"{tmp_path}/log"))
    expected = defaultdict(int)
    for k in range(11):
        for x in range(k, k + 3):
            expected[x] += 1
    assert {r.k: r.n for r in total.collect()} == expected
    # A run that was not finished counts for nothing, and one that another holds is not read.
    files.write_text(spark, "x", f"{tmp_path}/log/run-9-11/part-0.parquet")
    spark.createDataFrame([(5, 100)], "k long, n long").write.parquet(f"{tmp_path}/log/run-4-4")
    again = T.latest(T.table_stream(spark, f"{tmp_path}/in"), T.added(["k"], ["n"]), "append", f"{tmp_path}/log")
    assert {r.k: r.n for r in again.collect()} == expected


def test_rounds_are_made_in_tasks_and_a_restart_repeats_none(spark, tmp_path):
    spark.dataSource.register(RoundSource)
    source = lambda rounds: spark.readStream.format("rounds").options(streams=40, rounds=rounds, width=9, seed=4, step=25, group=7, chunk=10).load()
    for rounds in (60, 60, 130):  # what was there, nothing new, and more
        run = source(rounds).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/rows").trigger(processingTime="0 seconds").start()
        run.processAllAvailable()
        parts = [p.numInputRows for p in run.recentProgress if p.numInputRows]
        run.stop()
        assert parts == {60: [1000, 1000, 400], 130: [1000, 1000, 800]}[rounds] or (rounds == 60 and not parts)
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/rows").collect()]
    assert len(got) == 40 * 130 and set(got) == {(s, k, bits_of(4, s, k, 9)) for s in range(40) for k in range(1, 131)}
    batch = spark.read.format("rounds").options(streams=40, rounds=130, width=9, seed=4, group=7, chunk=50).load()
    assert batch.rdd.getNumPartitions() == 18 and batch.count() == 40 * 130


def killed():
    """A sink that stops once between writing and committing, and once after the manifest stands but before the stream knows; made here, so that workers get it by value."""

    class Killed(records.RecordSink):
        @classmethod
        def name(cls):
            return "killed"

        def streamWriter(self, schema, overwrite):
            where, mark = self.options["path"], self.options["mark"]

            class Writer(records._Writer):
                def commit(self, messages, batchId):
                    stage = len(os.listdir(mark))
                    if stage == 0 and batchId == 1:
                        open(f"{mark}/a", "w").close()
                        raise RuntimeError("killed before the commit")
                    super().commit(messages, batchId)
                    if stage == 1 and batchId == 1:
                        open(f"{mark}/b", "w").close()
                        raise RuntimeError("killed after the commit")

            return Writer(where)

    return Killed


def test_records_are_there_once_whatever_is_killed(spark, tmp_path):
    for k in range(3):
        put(spark, [(k * 10 + x, f"é{x}" if x else None) for x in range(10)], "id long, s string", f"{tmp_path}/in")
    os.makedirs(f"{tmp_path}/mark")
    spark.dataSource.register(killed())
    stream, out = T.table_stream(spark, f"{tmp_path}/in"), f"file://{tmp_path}/out"
    for k in range(3):
        run = stream.writeStream.format("killed").option("path", out).option("mark", f"{tmp_path}/mark").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        if k < 2:
            with pytest.raises(Exception, match="killed"):
                run.awaitTermination()
            assert records.recorded(spark, out, stream.schema).count() == (10, 20)[k]
        else:
            run.awaitTermination()
    rows = sorted(map(tuple, records.recorded(spark, out, stream.schema).collect()))
    assert rows == [(k * 10 + x, f"é{x}" if x else None) for k in range(3) for x in range(10)]
    assert records.recorded(spark, f"{tmp_path}/nothing", stream.schema).count() == 0


def test_a_key_is_requested_once_within_the_watermark(spark, tmp_path):
    rows = [("a", 10, 0), ("b", 20, 0), ("a", 30, 1), ("c", 40, 1), ("b", 50, 2), ("a", 60, 2)]
    df = spark.createDataFrame(rows, "k string, t long, file int").select("k", stamp("t").alias("t"), "file")
    out = arrivals.drained(T.once(arrivals.in_files(df, F.col("file"), 3), ["k"], "t", "1 hour"))
    assert sorted((r.k, int(r.t.timestamp())) for r in out.rows.collect()) == [("a", 10), ("b", 20), ("c", 40)]


def test_assemblies_fire_once_and_are_let_go(spark, tmp_path):
    rows = [("a", 1, 2, 10, 0), ("b", 1, 2, 10, 0), ("a", 1, 2, 11, 0), ("a", 2, 2, 20, 1), ("a", 3, 2, 21, 1), ("c", 1, 1, 20, 1), ("b", 1, 2, 30, 2), ("a", 2, 2, 30, 2), ("d", 1, 2, 5000, 2), ("d", 2, 2, 5000, 3)]
    df = spark.createDataFrame(rows, "k string, f long, total long, t long, file int").withColumn("t", stamp("t"))
    out = arrivals.drained(stateful.assembled(arrivals.in_files(df, F.col("file"), 4, "t"), "k", "f", "total", "t", "10 seconds", 60_000))
    assert sorted((r.k, r.complete) for r in out.rows.collect()) == [("a", True), ("b", False), ("c", True), ("d", True)]
    assert out.state_rows == 0


def test_all_orders_are_assembled(spark, tmp_path):
    """Only orders divisible by 5 were read, in the query and in its SQL; lines without a number came in no file."""
    rows = [(k, n, day) for k in range(1, 13) for n, day in ((1, 9000), (3, 9010))] + [(5, None, 9000), (13, None, 9020), (None, 2, 9020), (None, None, 9020)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, day int").select("l_orderkey", "l_linenumber", F.date_from_unix_date("day").cast("timestamp_ntz").alias("l_shipdate"))
    df.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    db = duckdb.connect()
    db.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    got = [(r.l_orderkey, r.complete) for r in catalogue.queries()["stream_assembled_and_evicted"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([(k, 2 >= 1 + k % 6) for k in range(1, 13)] + [(13, False), (None, None)], key=str)
    assert sorted(got, key=str) == sorted(db.execute(catalogue.oracle_sql()["stream_assembled_and_evicted"]).fetchall(), key=str)


@pytest.mark.parametrize("seed", range(2))
def test_a_full_store_holds_rounds_back(spark, tmp_path, seed):
    rng, ops = random.Random(seed), []
    for k in range(60):
        at = k * 2 + rng.randrange(2)
        ops.append(("a", at, 1, "store", k, rng.randint(1, 5)))
        ops.append(("a", at + rng.randint(1, 30), 0, "release", k, None))
    ops.sort(key=lambda o: (o[1], o[2], o[4]))
    ops = [(*o[:2], place, *o[3:]) for place, o in enumerate(ops)]
    stored, line, expected = {}, [], []
    for _, tick, _, op, r, bits in ops:
        if op == "store":
            line.append((r, bits, tick))
        else:
            stored.pop(r, None)
            line = [x for x in line if x[0] != r]
        while line and sum(stored.values()) + line[0][1] <= 9:
            r, bits, arrived = line.pop(0)
            stored[r] = bits
            expected.append((r, arrived, tick))
    for k in range(3):
        put(spark, ops[k * 40 : (k + 1) * 40], "k string, tick long, place long, op string, round long, bits long", f"{tmp_path}/ops")
        out = arrivals.drained(stateful.bounded_store(T.table_stream(spark, f"{tmp_path}/ops"), "k", 9), path=f"{tmp_path}/out")
    assert sorted((r.round, r.arrived, r.admitted) for r in out.rows.collect()) == sorted(expected) and out.state_rows == 0
    assert any(a > b for _, b, a in expected)
