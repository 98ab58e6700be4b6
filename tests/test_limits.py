"""Operators at ties, at their limits and on larger tables."""

import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from trialspan.llm import quality
from trialspan.operators import aggregates as A
from trialspan.operators import graph, scans, sets
from trialspan.operators import joins as J
from trialspan.plans import catalogue
from trialspan.streaming import arrivals, stateful


@pytest.fixture
def against_sql(spark, tmp_path):
    """Writes tables and compares a query over them with its SQL."""

    def check(name, **tables):
        db = duckdb.connect()
        for table, df in tables.items():
            df.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
            db.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
        want = db.execute(catalogue.oracle_sql()[name])
        names = [c[0] for c in want.description]
        assert sorted(map(tuple, catalogue.queries()[name](spark, str(tmp_path)).select(names).collect())) == sorted(want.fetchall())

    return check


def test_nearest_row_sorts_different_values_once_each_way(spark):
    cards = spark.createDataFrame([("a", 1.0, 7), (None, 3.0, 4)], "k string, size double, card long")
    df = spark.range(30_000).select(F.lit("a").alias("k"), (F.col("id") % 3).cast("double").alias("at")).union(spark.createDataFrame([("a", None), (None, 9.0)], "k string, at double"))
    out = J.nearest_row(df, cards, ["k"], "at", "size", "card")
    assert {tuple(r) for r in out.distinct().collect()} == {("a", 0.0, 7), ("a", 1.0, 7), ("a", 2.0, 7), ("a", None, None), (None, 9.0, 4)}
    assert out.count() == 30_002
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()


def test_controller_rounds_halves_to_even(spark, against_sql):
    """Values that end in .5: block means differ by how they are rounded."""
    value = (F.pmod(F.hash("id"), F.lit(8)) + 0.5).cast("double")
    e = spark.range(5000).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("view").alias("event_type"), value.alias("value"), F.lit("").alias("props"))
    against_sql("controller_steps", events=e)


def test_pooled_sums_without_a_needless_scale(spark):
    """5, 42 against 5, 45: scaled by the least weight both sums are 1; where exp leaves the doubles the scale stays."""
    rows = [(1, "A", 5.0), (1, "A", 42.0), (1, "R", 5.0), (1, "R", 45.0), (2, "A", 800.0), (2, "R", 801.0), (3, "A", -800.0), (3, "R", -799.0)]
    df = spark.createDataFrame(rows, "k long, answer string, weight double")
    assert dict(map(tuple, A.sum_likelihood(df, ["k"], "answer", "weight").collect())) == {1: "A", 2: "A", 3: "A"}


def test_pooled_sums_are_taken_in_the_order_of_rows(spark, against_sql):
    """exp(-48) is lost when it is added to exp(-11), and two of them are not: tasks that summed their own rows first gave N, however the rows were dealt."""
    rows = [(1, "N", 11.0), (1, "R", 11.0), (1, "N", 48.0), (1, "N", 48.0)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_returnflag string, l_quantity double")
    for parts in (1, 2, 4):
        dealt = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), df.schema)
        assert [tuple(r) for r in A.sum_likelihood(dealt, ["l_orderkey"], "l_returnflag", "l_quantity").collect()] == [(1, "R")]
    against_sql("pooled", lineitem=df)


def test_pooled_keeps_rows_without_a_key(spark):
    """A join by key left them out; the SQL has them."""
    df = spark.createDataFrame([(None, "A", 3.0), (None, "R", 2.0)], "k long, answer string, weight double")
    assert [tuple(r) for r in A.sum_likelihood(df, ["k"], "answer", "weight").collect()] == [(None, "R")]


def test_state_has_no_more_parts_than_tasks_run_at_once(spark):
    """However many partitions shuffles have: each part of the state costs its time in every micro-batch."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        with arrivals.rocks(spark):
            assert int(spark.conf.get("spark.sql.shuffle.partitions")) == spark.sparkContext.defaultParallelism
        assert spark.conf.get("spark.sql.shuffle.partitions") == "64"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_timers_need_no_python_row_by_row(spark):
    """Sessions of Spark's own: a process of Python for each key took over 300 s for a million orders."""
    made = spark.readStream.format("rate").load().select(F.col("value").alias("k"), F.col("timestamp").alias("made"), (F.col("timestamp") + F.expr("interval 1 day")).alias("due"))
    cut = made.select("k", F.col("made").alias("at"))
    plan = stateful.fired_timers(made, cut, "k", "made", "due", "at", "1 day", 1000)._jdf.queryExecution().analyzed().toString()
    assert "Python" not in plan and "session_window" in plan


def test_lifetimes_need_no_python_row_by_row(spark):
    stream = spark.readStream.format("rate").load()
    plan = stateful.hold_lifetimes(stream, "value", F.lit(0), "timestamp", 1000, "1 day")._jdf.queryExecution().analyzed().toString()
    assert "Python" not in plan and "session_window" in plan


def test_assemblies_are_taken_a_bucket_at_a_time(spark):
    """A call of Python for each key and batch took 61 s for 30,000 keys; large keys, null ones and null fragments keep their values."""
    e = spark.range(6000).select((F.col("id") % 3000 + 2**53).alias("k"), F.floor(F.col("id") / 3000).alias("f"), (1 + F.col("id") % 3).alias("total"), F.timestamp_seconds(F.lit(9)).alias("t"))
    odd = spark.createDataFrame([(None, 1, 1, 9), (7, None, 1, 9)], "k long, f long, total long, t long").withColumn("t", F.timestamp_seconds("t"))
    out = arrivals.drained(stateful.assembled(arrivals.in_files(e.union(odd), F.coalesce("f", F.lit(0)), 2), "k", "f", "total", "t", "10 seconds", 60_000, 16))
    assert out.state_rows <= 16  # before: one for each key and fragment that is open, and its timer
    got = out.rows.collect()  # whole ones at once, though the stream is open
    assert len(got) == 2000 and {(r.k - 2**53, r.have, r.need, r.complete) for r in got} == {(k, 1 + k % 3, 1 + k % 3, True) for k in range(3000) if k % 3 < 2}


def test_windows_are_joined_a_bucket_at_a_time_and_let_go(spark):
    """Each row was several reads of Spark's state, and the row that closes the facts was filtered out before it moved their watermark."""
    n, big = 500, 2**53
    w = spark.range(n).select((F.col("id") + big).alias("k"), F.timestamp_seconds(F.lit(100)).alias("begun"))
    f = spark.range(n).where("id % 3 > 0").select((F.col("id") + big).alias("k"), F.timestamp_seconds(F.lit(150)).alias("at"), F.concat(F.lit("é\""), "id").alias("kind"), F.when(F.col("id") % 3 == 1, F.col("id") + 2**60).alias("value"))
    odd = spark.createDataFrame([(None, 150, "x", 1), (big, None, "x", 1)], "k long, at long, kind string, value long").withColumn("at", F.timestamp_seconds("at"))
    facts, windows = arrivals.in_files(f.union(odd), F.when(F.col("kind") == "x", 1).otherwise(0), 2, "at"), arrivals.in_files(w, F.col("k") % 2, 2, "begun")
    out = arrivals.drained(stateful.pending_releases(windows, facts, "k", "begun", "at", "value", "kind", "1 hour", "10 seconds", "0 seconds", 16))
    got = sorted((r.k - big, r.kind, r.value) for r in out.rows.where("k is not null").collect())
    assert got == [(k, f'é"{k}' if k % 3 else None, k + 2**60 if k % 3 == 1 else None) for k in range(n)]
    assert out.state_rows == 1  # the closing window


def test_arrivals_are_as_many_files_as_their_size_needs(spark, monkeypatch):
    """One task wrote and read each micro-batch, however large; now each has the same number of files, empty ones among them."""
    monkeypatch.setattr(arrivals, "FILE_BYTES", 1000)
    df = spark.range(40_000, numPartitions=8).select("id", F.timestamp_seconds("id").alias("t"))
    s = arrivals.in_files(df, F.when(F.col("id") == 5, 1).when(F.col("id") < 20_000, 0).otherwise(2), 3, "t")
    out = arrivals.drained(s)
    assert out.rows.count() == 40_001 and out.batches == 4
    sizes = out.rows.where("id is not null").groupBy(F.input_file_name()).count().count()
    assert sizes > 3  # more than one task of a micro-batch wrote


def test_few_windows_are_objects_at_a_time(spark):
    """A batch of 8,000 windows of 64 edges was half a million dicts at once."""
    edge = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.struct(k.alias("a"), (k + 1).alias("b"), F.lit(0.5).alias("w")))
    w = spark.range(8000, numPartitions=1).select("id", F.lit(65).alias("nodes"), edge.alias("edges"), F.array("id").alias("marked"))
    r = graph.decoded(w, "id", lambda nodes, edges, marked: [sys.getallocatedblocks(), len(edges), *marked]).collect()
    assert [(x.id, *x.correction[1:]) for x in r] == [(k, 64, k) for k in range(8000)]
    assert max(x.correction[0] for x in r) < 1_000_000


def test_blocks_are_bounded_in_number(spark):
    """Bounds are part of the plan: 10,000 of them were more code than a method may have."""
    x = scans.blocked(spark.range(4000), "id", 2).groupBy("__block").agg(F.count("*").alias("n")).collect()
    assert len(x) == scans.BLOCKS and sum(r.n for r in x) == 4000 and max(r.n for r in x) <= 3 * 4000 / scans.BLOCKS


def test_all_trusted_rows_are_trusted(spark):
    labels = spark.range(21_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert quality.trusted_ids(labels).count() == 21_000


def test_intervals_are_sorted_in_as_many_tasks_as_shuffles_have(spark):
    df = spark.range(2000).select((F.col("id") % 50).alias("k"), F.col("id").alias("lo"), (F.col("id") + 1).alias("hi"))
    out = sets.interval_gaps(df, ["k"], "lo", "hi", F.lit(0).cast("long"), F.lit(3000).cast("long"))
    assert out.count() == 50 * 40 + 49  # one before each key's first but the one at 0, 39 between, one after
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") + plan.count("Range (") == 1 and "REPARTITION_BY_NUM" in plan


def test_intervals_without_an_end_are_joined_as_in_sql(spark, against_sql):
    """Spark sorts nulls first: they came out as intervals of their own, and an interval without an end parted those that begin with it."""
    rows = [(1, 9000, 1), (1, 9000, None), (1, 9001, 2), (1, None, 1), (1, 9100, 0), (2, 9000, 0), (2, None, None), (2, 9050, None)]
    df = spark.createDataFrame(rows, "l_suppkey long, day int, l_linenumber int")
    out = sets.joined_intervals(df.select("l_suppkey", F.col("day").alias("lo"), (F.col("day") + 1 + F.col("l_linenumber")).alias("hi")), ["l_suppkey"], "lo", "hi")
    assert {tuple(r) for r in out.collect()} == {(1, 9000, 9004), (1, 9100, 9101), (2, 9000, 9001), (2, 9050, None)}
    against_sql("interval_union", lineitem=df.select("l_suppkey", "l_linenumber", F.date_from_unix_date("day").cast("timestamp_ntz").alias("l_shipdate")))
