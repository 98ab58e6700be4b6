"""Streaming queries, drained to the end; each equals its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspan.plans.catalogue import oracle, query
from trialspan.plans.tables import EVENTS, table
from trialspan.session import fresh_path
from trialspan.streaming import arrivals, records, stateful
from trialspan.streaming import rounds as T


def _stream(spark, sf_dir, name):
    return T.table_stream(spark, f"{sf_dir}/{name}.parquet")


@query(f"select event_type, count(*) as n, cast(sum(event_id) as bigint) as ids from {EVENTS} group by all")
def stream_role_totals(spark, sf_dir):
    e = _stream(spark, sf_dir, "events").select("event_type", F.lit(1).cast("long").alias("n"), F.col("event_id").alias("ids"))
    return T.latest(e, lambda before, batch: T.added(["event_type"], ["n", "ids"])(before, batch), "append")


@query("select conv_id, i as index, i * 3 + 1 as commit_lo, i * 3 + 3 as commit_hi from (select conv_id, count(distinct turn) as n from conversations group by conv_id), range(1000) t(i) where i * 3 + 5 <= n")
def stream_ready_windows(spark, sf_dir):
    c = _stream(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("r"))
    return T.drained(T.ready_windows(c, "conv_id", "r", 3, 2))


@query("select conv_id, i as index, i * 3 + 1 as commit_lo, least((i + 1) * 3, n) as commit_hi from (select conv_id, max(turn) + 1 as n from conversations group by conv_id having count(distinct turn) = max(turn) + 1), range(1000) t(i) where i < ceil(n / 3)")
def stream_sealed_windows(spark, sf_dir):
    c = _stream(spark, sf_dir, "conversations")
    ends = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg((F.max("turn") + 1).alias("last"))
    rounds = c.join(ends, "conv_id").select("conv_id", (F.col("turn") + 1).alias("r"), "last")
    return T.drained(T.ready_windows(rounds, "conv_id", "r", 3, 2, "last"))


@query("select l_orderkey from lineitem group by all having count(distinct l_linenumber) >= max(l_partkey % 4)")
def stream_assembled(spark, sf_dir):
    line = _stream(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("fragment"), (F.col("l_partkey") % 4).alias("total"))
    return T.latest(T.assembled(line, ["l_orderkey"], "fragment", "total"), T.upsert(["l_orderkey"], -F.col("have"))).select("l_orderkey")


@query(f"select user_id, event_type, event_id, rank from (select user_id, event_type, event_id, event_id % 5 as rank, row_number() over (partition by user_id, event_type order by event_id % 5, event_id desc) as r from {EVENTS}) where r = 1")
def stream_revisions(spark, sf_dir):
    e = _stream(spark, sf_dir, "events").select("user_id", "event_type", "event_id", (F.col("event_id") % 5).alias("rank"))
    return T.latest(e, T.upsert(["user_id", "event_type"], F.struct(F.col("rank"), -F.col("event_id"))), "append")


@query(f"""with recursive e as (select user_id, row_number() over (partition by user_id order by event_id) as n, value as g from {EVENTS}), r as (select user_id, n, 20.0::double + 0.5 * (0.2 - cast(g < 20.0 as int)) as theta, cast(g < 20.0 as int) as k from e where n = 1
union all select e.user_id, e.n, r.theta + 0.5 * (0.2 - cast(e.g < r.theta as int)), r.k + cast(e.g < r.theta as int) from r join e on e.user_id = r.user_id and e.n = r.n + 1)
select user_id, max(n) as rows, round(arg_max(theta, n), 9) as threshold, cast(arg_max(k, n) as bigint) as escalated from r group by all""")
def stream_adaptive_threshold(spark, sf_dir):
    steps = T.drained(T.adapted(_stream(spark, sf_dir, "events"), "user_id", "event_id", "value", 0.2, 20.0, 0.5))
    last = steps.groupBy("user_id").agg(F.max_by(F.struct("rows", "threshold", "escalated"), "rows").alias("x")).select("user_id", "x.*")
    return last.withColumn("threshold", F.round("threshold", 9))


@query("select cast(date_trunc('hour', ts) as timestamp) as start, event_type, count(*) as n from events group by all")
def stream_tumbling(spark, sf_dir):
    e = _stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("t"), "event_type")
    counts = T.tumbling(e, "t", "1 hour", "365 days", ["event_type"])
    return T.latest(counts, T.upsert(["start", "event_type"], -F.col("n"))).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def _stored_or_released():
    return F.when(F.col("event_type") == "view", 0).when(F.col("event_type").isin("purchase", "click"), 1).otherwise(2)


def _timed(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(oracle("hold_lifetime"))
def stream_hold_lifetime(spark, sf_dir):
    """Users' events in four files in no order; the last file closes all of them."""
    e = arrivals.in_files(_timed(spark, sf_dir).select("user_id", "ts", "event_type", "event_id"), F.col("event_id") % 4, 4, "ts")
    return arrivals.drained(stateful.hold_lifetimes(e, "user_id", _stored_or_released(), "ts", 365 * 86_400_000, "365 days")).rows


def _hold_ops():
    """Windows commit 3 rounds and read 2 more; w<i> holds what window i reads until it is complete, and if its last round escalates, s<i> holds it one round on."""
    none, no_rounds, at_end = F.lit(None).cast("string"), F.lit(None).cast("array<bigint>"), "r >= 5 and (r - 5) % 3 = 0"
    ops = (
        ("store", "true", none, none, F.array("r")),
        ("register", "(r - 1) % 3 = 0", F.expr("concat('w', (r - 1) div 3)"), none, F.expr("sequence(r, r + 4)")),
        ("release", "r >= 6 and (r - 6) % 3 = 0", F.expr("concat('s', (r - 6) div 3)"), none, no_rounds),
        ("transfer", f"{at_end} and up", F.expr("concat('w', (r - 5) div 3)"), F.expr("concat('s', (r - 5) div 3)"), no_rounds),
        ("release", f"{at_end} and not up", F.expr("concat('w', (r - 5) div 3)"), none, no_rounds),
    )
    every = (F.when(F.expr(when), F.struct((F.col("r") * 10).alias("tick"), F.lit(place).alias("place"), F.lit(op).alias("op"), holder.alias("holder"), other.alias("other"), rounds.alias("rounds"))) for place, (op, when, holder, other, rounds) in enumerate(ops))
    return F.filter(F.array(*every), lambda x: x.isNotNull())


@query("""with c as (select conv_id, turn + 1 as r, length(text) % 4 = 0 as up, count(*) over (partition by conv_id) as n from conversations),
w as (select conv_id, (r - 5) // 3 as i, case when not up then 10 * r when n > r then 10 * (r + 1) end as released from c where r >= 5 and (r - 5) % 3 = 0),
h as (select c.conv_id, c.r, i.i, w.released from c cross join range(1000) i(i) left join w on w.conv_id = c.conv_id and w.i = i.i where c.r between 3 * i.i + 1 and 3 * i.i + 5 and 3 * i.i + 1 <= c.n)
select conv_id, r as round, 10 * r as stored, max(released) as freed from h group by conv_id, r having count(*) = count(released)""")
def stream_round_holds(spark, sf_dir):
    """Rounds leave their store when the last window that reads them is complete, or its escalation is."""
    c = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).cast("long").alias("r"), (F.length("text") % 4 == 0).alias("up"))
    s = arrivals.in_files(c, F.least(F.floor((F.col("r") - 1) / 2), F.lit(3)), 4)
    ops = s.select("conv_id", F.explode(_hold_ops()).alias("op")).select("conv_id", "op.*")
    return arrivals.drained(stateful.round_holds(ops, "conv_id")).rows


def _slice(date):
    """Two years a file, 0 to 3."""
    return F.greatest(F.lit(0), F.least(F.lit(3), F.floor((F.year(date) - 1995) / 2)))


@query(oracle("timers_fired"))
def stream_timers_fired(spark, sf_dir):
    """Orders set a timer of 60 days, returned lines cancel it; two streams of four files each in the order of time."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("made")).withColumn("due", F.col("made") + F.expr("interval 60 days"))
    c = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").cast("timestamp").alias("at"))
    timers, cancels = arrivals.in_files(o, _slice("made"), 4, "made"), arrivals.in_files(c, _slice("at"), 4, "at")
    out = arrivals.drained(stateful.fired_timers(timers, cancels, "o_orderkey", "made", "due", "at", "1 day", 3000 * 86_400_000)).rows
    return out.select("o_orderkey", F.unix_date(F.col("due").cast("date")).cast("long").alias("due"))


@query(oracle("cut_regions"))
def stream_growing_regions(spark, sf_dir):
    """Turns come in five files in no order."""
    c = arrivals.in_files(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), (F.col("turn") * 7 + F.col("conv_id")) % 5, 5)
    laid = stateful.growing_regions(c, "conv_id", "turn", F.length("text") % 7 == 0, 3)
    with arrivals.rocks(spark):
        return T.latest(laid, T.upsert(["conv_id", "region"], -F.col("hi")), "append").select("conv_id", "region", "lo", "hi")


@query(oracle("pending_release"))
def stream_pending_release(spark, sf_dir):
    """Orders are held until a returned and a finished line are there; a stream-stream join over files in the order of time."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("begun"))
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").cast("timestamp").alias("at"), "l_returnflag", "l_linestatus", "l_suppkey", "l_partkey")
    facts = F.array(F.when(F.col("l_returnflag") == "R", F.struct(F.lit("committed").alias("kind"), F.col("l_suppkey").alias("value"))), F.when(F.col("l_linestatus") == "F", F.struct(F.lit("stored").alias("kind"), F.col("l_partkey").alias("value"))))
    line = line.select("o_orderkey", "at", F.explode(F.filter(facts, lambda x: x.isNotNull())).alias("f")).select("o_orderkey", "at", "f.*")
    joined = stateful.pending_releases(arrivals.in_files(o, _slice("begun"), 4, "begun"), arrivals.in_files(line, _slice("at"), 4, "at"), "o_orderkey", "begun", "at", "value", "kind", "3000 days", "3000 days", "1 day")
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("value")))
    both = arrivals.drained(joined).rows.groupBy("o_orderkey").agg(of("committed").alias("c"), of("stored").alias("s"))
    return both.where("c is not null and s is not null").select("o_orderkey", F.greatest("c", "s").alias("released"))


@query(oracle("stream_revisions"))
def stream_revisions_over_files(spark, sf_dir):
    """Twenty files; each batch writes a run of its own size and runs are merged in powers of eight."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", (F.col("event_id") % 5).alias("rank"))
    s = arrivals.in_files(e, F.col("event_id") % 20, 20)
    return T.latest(s, T.upsert(["user_id", "event_type"], F.struct(F.col("rank"), -F.col("event_id"))), "append")


@query(f"select event_type, count(*) as n, cast(sum(event_id) as bigint) as ids, cast(max(user_id) as bigint) as last_user from {EVENTS} group by all")
def stream_recorded(spark, sf_dir):
    """Events in three files, written by the record sink and read back by its manifests."""
    s = arrivals.in_files(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), F.col("event_id") % 3, 3)
    path = fresh_path(spark, "records")
    records.record(s, path, f"{path}-state")
    return records.recorded(spark, path, s.schema).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.max("user_id").alias("last_user"))


@query("select l_orderkey, min(l_linenumber)::bigint as line from lineitem group by all")
def stream_requested_once(spark, sf_dir):
    """Each order is requested once, by the first of its lines that comes: lines in the order of their numbers, two files."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"))
    first = line.groupBy("l_orderkey").agg(F.min("line").alias("first"))
    staged = line.join(first, "l_orderkey").select("l_orderkey", "line", (F.col("line") > F.col("first")).cast("int").alias("later"), F.timestamp_seconds("line").alias("t"))
    s = arrivals.in_files(staged, F.col("later"), 2)
    return arrivals.drained(T.once(s, ["l_orderkey"], "t", "1 hour")).rows.select("l_orderkey", "line")


@query("select l_orderkey, count(distinct l_linenumber) >= 1 + l_orderkey % 6 as complete from lineitem group by l_orderkey")
def stream_assembled_and_evicted(spark, sf_dir):
    """Orders whose lines come in three files in no order: whole ones at once, the others when their time is over, and no state is left."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (1 + F.col("l_orderkey") % 6).alias("total"), F.col("l_shipdate").cast("timestamp").alias("t"))
    s = arrivals.in_files(line, F.coalesce((F.col("l_linenumber") * 5 + F.col("l_orderkey")) % 3, F.lit(0)), 3, "t")
    done = arrivals.drained(stateful.assembled(s, "l_orderkey", "l_linenumber", "total", "t", "4000 days", 86_400_000))
    keyless = line.where("l_orderkey is null").select("l_orderkey", F.lit(None).cast("boolean").alias("complete")).distinct()  # one group in SQL; in the stream they only move the watermark
    return done.rows.select("l_orderkey", "complete").union(keyless)


@query("with c as (select conv_id, turn as round, 10 * turn as arrived, 10 * turn + 35 + length(text) % 7 as released from conversations) select conv_id, round, arrived, greatest(arrived, coalesce(lag(released, 2) over (partition by conv_id order by round), arrived)) as admitted from c")
def stream_bounded_store(spark, sf_dir):
    """A store with room for two rounds of eight bits: the third is held back until the first one leaves. Files are in the order of ticks."""
    c = table(spark, sf_dir, "conversations")
    r, ten = F.col("turn").cast("long"), F.col("turn").cast("long") * 10
    op = lambda name, place, tick: F.struct(tick.alias("tick"), F.lit(place).alias("place"), F.lit(name).alias("op"), r.alias("round"), F.lit(8).cast("long").alias("bits"))
    ops = c.select("conv_id", F.explode(F.array(op("release", 0, ten + 35 + F.length("text") % 7), op("store", 1, ten))).alias("x")).select("conv_id", "x.*")
    s = arrivals.in_files(ops, F.least(F.floor(F.col("tick") / 30), F.lit(3)), 4)
    return arrivals.drained(stateful.bounded_store(s, "conv_id", 16)).rows
