"""Queries of requests, devices, selections and measures over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trialspan.functions import estimators as E
from trialspan.functions import scalars as S
from trialspan.functions import selection as X
from trialspan.operators import devices as D
from trialspan.operators import joins as J
from trialspan.operators import aggregates as A
from trialspan.operators import measures as M
from trialspan.operators import plugins as P
from trialspan.operators import requests as R
from trialspan.operators import sets
from trialspan.plans.catalogue import query
from trialspan.plans.tables import EVENTS, day, day_sql, events, table


@query("select l_orderkey, l_linenumber, l_partkey, o_custkey % 7 as pool from lineitem join orders on o_orderkey = l_orderkey where o_custkey % 7 in (1, 3)")
def pool_requests(spark, sf_dir):
    requests = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    lives = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 7).alias("pool"))
    return R.requests_of_pools(requests, lives, spark.createDataFrame([(1,), (3,)], "pool long"), ["l_orderkey"], "pool")


@query("select o_orderkey, o_custkey, c_nationkey, v.p, p_size from orders left join customer on c_custkey = o_custkey and c_acctbal > 0 left join (select l_orderkey, min(l_partkey) as p from lineitem where l_returnflag = 'R' group by all) v on v.l_orderkey = o_orderkey left join part on p_partkey = v.p")
def outcome_rows(spark, sf_dir):
    outcomes = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    windows = outcomes.join(customers, "o_custkey").select("o_orderkey", "c_nationkey")
    verdicts = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_partkey").alias("p"))
    return R.outcome_rows(outcomes, windows, verdicts, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"), "p_size"), ["o_orderkey"], ["p"])


@query("select l_returnflag, l_linestatus, round(avg(l_discount), 8) as busy_mean, round(avg(l_tax), 8) as load_mean, max(l_linenumber) as queue_max, sum(l_quantity) as windows from lineitem group by all")
def pool_summary(spark, sf_dir):
    out = R.pool_summary(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_discount", "l_tax", "l_linenumber", "l_quantity")
    return out.withColumns({c: F.round(c, 8) for c in ("busy_mean", "load_mean")})


@query(f"select k * 10.0 as threshold_db, count(*) as shots, count(*) filter (where value < k * 10 and event_id % 3 = 0) as failures, count(*) filter (where value < k * 10) / count(*) as escalated_share from {EVENTS}, range(1, 6) t(k) group by k")
def static_frontier(spark, sf_dir):
    v, one = F.col("value"), F.lit(1)
    chain = lambda k: F.struct(F.lit(k * 10.0).alias("threshold_db"), F.when((v < k * 10) & (F.col("event_id") % 3 == 0), 1).otherwise(0).alias("failures"), one.alias("shots"), F.when(v < k * 10, 1).otherwise(0).alias("escalated"), one.alias("windows"))
    lines = events(spark, sf_dir).select(F.array(*(chain(k) for k in range(1, 6))).alias("chains"))
    return R.frontier(lines, "chains").drop("estimate", "low", "high")


@query("select o_orderstatus, o_orderpriority, count(*) as seeds, round(avg(o_custkey % 10 / 10.0), 8) as share, max(o_totalprice) as backlog, cast(sum(o_custkey % 2) as bigint) as failures from orders group by all")
def seed_means(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", (F.col("o_custkey") % 10 / 10.0).alias("share"), F.col("o_totalprice").alias("backlog"), (F.col("o_custkey") % 2).alias("failures"))
    return R.seed_means(o, ["o_orderstatus", "o_orderpriority"], ["share"], ["backlog"], ["failures"]).withColumn("share", F.round("share", 8))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_linenumber + l_quantity / 7.0, 8) as backlog_rounds from lineitem")
def round_backlog(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    out = R.round_backlog(line, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], F.col("l_linenumber"), F.col("l_quantity"), F.lit(7.0))
    return out.withColumn("backlog_rounds", F.round("backlog_rounds", 8))


_TURNS = "(select conv_id, turn + 1 as r, length(text) as t from conversations)"


@query(f"""with one as (select conv_id, r, min(t) as t, min(t) + 40 as f from {_TURNS} group by all),
run as (select conv_id, r, max(t) over w as t, max(f) over w as f, row_number() over w as n from one window w as (partition by conv_id order by r)),
ev as (select conv_id, t, 1 as d from run where n = r union all select conv_id, f, -1 from run where n = r),
tick as (select conv_id, t, sum(d) as d from ev group by all)
select conv_id, cast(max(level) as bigint) as peak from (select conv_id, sum(d) over (partition by conv_id order by t) as level from tick) group by all""")
def tick_end_backlog(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("r"), F.length("text").cast("long").alias("t"))
    return R.tick_end_backlog(c, c.withColumn("t", F.col("t") + 40), ["conv_id"], "t", "r")


@query("select l_returnflag, round(sum(abs(l_tax - l_discount)), 6) as gap, count(*) as n from lineitem group by all")
def confidence_signal(spark, sf_dir):
    line = R.with_signal(table(spark, sf_dir, "lineitem"), "complementary", "l_discount", "l_tax")
    return line.groupBy("l_returnflag").agg(F.round(F.sum("gap"), 6).alias("gap"), F.count("*").alias("n"))


@query("select o_orderpriority, count(*) as checked, count(*) filter (where o_custkey % 3 <> o_orderkey % 3) as disagreed from orders where o_orderstatus <> 'P' group by all")
def referee(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return R.refereed(o, ["o_orderpriority"], F.col("o_custkey") % 3, F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey") % 3))


_SERIAL = "select *, sum(s) over w + max(r0 - before) over w as fin from (select *, sum(s) over w - s as before from {t} window w as (partition by {k} order by {o} rows unbounded preceding)) window w as (partition by {k} order by {o} rows unbounded preceding)"


@query(f"select event_id, fin - s as start, fin as \"end\", fin - s - r0 as waited from ({_SERIAL.format(t=f'(select event_id, user_id, tick as r0, event_id % 1000 * 100000 as s from {EVENTS})', k='user_id', o='r0, event_id')})")
def device_slots(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "user_id", F.col("tick").alias("at"), (F.col("event_id") % 1000 * 100000).alias("s"))
    return D.slots(e, ["user_id"], ["at", "event_id"], "at", "s", 1).select("event_id", "start", "end", "waited")


@query(f"select event_id, words, fin - s as start, fin as \"end\" from ({_SERIAL.format(t=f'(select event_id, event_type, tick as r0, greatest(ceil(value / 8)::bigint, 1) as words, greatest(ceil(value / 8)::bigint, 1) * 5000 as s from {EVENTS})', k='event_type', o='r0, event_id')})")
def ported_store(spark, sf_dir):
    return D.ported_accesses(events(spark, sf_dir).withColumnRenamed("tick", "at"), ["event_type"], ["at", "event_id"], "at", F.col("value"), 8, 5000, 1).select("event_id", "words", "start", "end")


@query(f"select event_id, channel, fin - s as start, fin as \"end\", fin + 7 as landed from ({_SERIAL.format(t=f'(select event_id, length(event_type) % 2 as channel, tick as r0, event_id % 900 * 3 as s from {EVENTS})', k='channel', o='r0, event_id')})")
def fabric_sends(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "event_type", F.col("tick").alias("at"), (F.col("event_id") % 900).alias("bits"), F.lit(0).alias("run"))
    routes = e.select("event_type", (F.length("event_type") % 2).cast("long").alias("channel"), F.lit(3).alias("ticks_a_bit"), F.lit(7).alias("propagation")).distinct()
    return D.fabric_sends(e, routes, ["run"], "event_type", ["at", "event_id"], "at", "bits").select("event_id", "channel", "start", "end", "landed")


@query(f"select o_orderkey, k as round, {day_sql('o_orderdate')} + k * 3 as tick from orders, range(1, 11) t(k) where k <= o_custkey % 30 // 3")
def clock_rounds(spark, sf_dir):
    d = day("o_orderdate").cast("long")
    return D.clock_rounds(table(spark, sf_dir, "orders"), ["o_orderkey"], d, d + F.col("o_custkey") % 30, 3)


@query(f"select event_id, fin as committed from ({_SERIAL.format(t=f'(select event_id, user_id, tick as r0, 250000 as s from {EVENTS})', k='user_id', o='r0, event_id')})")
def frame_commits(spark, sf_dir):
    return D.frame_commits(events(spark, sf_dir), ["user_id"], ["tick", "event_id"], "tick", 250000).select("event_id", "committed")


@query(f"select o_orderkey, {day_sql('o_orderdate')} + 60 as due from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R' and {day_sql('l_shipdate')} < {day_sql('o_orderdate')} + 60)")
def timers_fired(spark, sf_dir):
    timers = table(spark, sf_dir, "orders").select("o_orderkey", (day("o_orderdate") + 60).cast("long").alias("due"))
    cancels = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), day("l_shipdate").cast("long").alias("at"))
    return D.fired(timers, cancels, "o_orderkey", "due", "at")


@query("select * exclude (embedding) from embeddings")
def scalar_fields(spark, sf_dir):
    return X.scalar_fields(table(spark, sf_dir, "embeddings"))


@query("select o_orderkey, o_custkey < 50 as kept from orders where o_orderkey >= 100 and o_orderkey < 1100")
def first_shots(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where(X.first_shots(F.col("o_orderkey"), 100, 1000))
    return o.select("o_orderkey", X.sampled(F.col("o_custkey"), 50).alias("kept"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_returnflag = 'R' and l_linenumber = 3 then 2 when l_linestatus = 'O' then 1 end as value from lineitem")
def path_assignments(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    path = F.concat_ws(".", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))
    return line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", X.assigned(path, [("*.O.*", 1), ("R.*.3", 2)]).alias("value"))


@query("select c_custkey, row_number() over (partition by c_nationkey order by encode(c_mktsegment || ':' || c_custkey)) as place from customer")
def canonical_order(spark, sf_dir):
    identity = F.concat_ws(":", "c_mktsegment", F.col("c_custkey").cast("string"))
    w = Window.partitionBy("c_nationkey").orderBy(X.canonical_order(identity))
    return table(spark, sf_dir, "customer").select("c_custkey", F.row_number().over(w).alias("place"))


@query("select l_suppkey, round(sum(l_quantity) / (4 * max(l_linenumber)), 8) as busy_fraction, round(sum(l_tax) / max(l_linenumber), 8) as offered_load from lineitem group by all")
def tier_load(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").alias("busy"), F.col("l_tax").alias("offered"), F.lit(4).alias("units"), "l_linenumber")
    out = M.tier_load(line, ["l_suppkey"], "units", F.col("l_linenumber"))
    return out.withColumns({c: F.round(c, 8) for c in ("busy_fraction", "offered_load")})


@query(f"select event_id, (tick - event_id % 977) / 1000000.0::double as us, tick - event_id % 977 as start, event_id % 4 = 0 as copied, value is not null and user_id is not null as complete from {EVENTS}")
def hop_starts(spark, sf_dir):
    e = events(spark, sf_dir)
    into = F.when(F.col("event_id") % 4 == 0, F.col("event_id"))
    return e.select("event_id", S.span_microseconds(F.col("tick"), F.col("event_id") % 977).alias("us"), S.hop_start(F.col("tick"), F.col("event_id") % 977).alias("start"), S.is_copy(into).alias("copied"), S.whole("value", "user_id").alias("complete"))


@query(f"select a.event_id as operation_id, a.tick - (b.tick + 500) as reaction from {EVENTS} a join {EVENTS} b on b.event_id = a.event_id - a.user_id where a.value > 1")
def conditional_reactions(spark, sf_dir):
    e = events(spark, sf_dir)
    ops = e.select(F.col("event_id").alias("operation_id"), (F.col("event_id") - F.col("user_id")).alias("blocked_by"), F.when(F.col("value") > 1, F.col("tick")).alias("started"), (F.col("tick") + 500).alias("done"))
    return M.conditional_reactions(ops)


@query("select l_partkey, min(l_orderkey) as place from lineitem group by all")
def first_seen(spark, sf_dir):
    return sets.first_seen(table(spark, sf_dir, "lineitem"), "l_partkey", "l_orderkey")


@query("select n_nationkey as source, n_regionkey as target from nation")
def pool_routes(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return J.routes(n.select("n_nationkey"), n.select(F.col("n_nationkey").alias("source"), F.col("n_regionkey").alias("target")), "n_nationkey")


@query("select l_returnflag, round(sum(l_tax) / 7.5, 6) as load, ceil(2 * sum(l_tax) / 7.5)::bigint as need from lineitem group by all")
def chain_need(spark, sf_dir):
    load, need = M.chain_need(F.col("l_tax"), 7.5)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(load, 6).alias("load"), need.cast("long").alias("need"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_quantity - 1) / (60 - 1.0), 8) as share, round(l_discount * 3 * 5, 8) as load, case when l_discount * 9 < 1 then round(l_discount * 9 / (1 - l_discount * 9), 6) end as wait from lineitem")
def queue_references(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    share = E.capacity_share(F.col("l_quantity"), F.lit(1.0), F.lit(60.0))
    return line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(share, 8).alias("share"), F.round(E.offered_load(F.col("l_discount"), F.lit(3), F.lit(5)), 8).alias("load"), F.round(E.utilisation_wait(F.col("l_discount") * 9), 6).alias("wait"))


_LINE = "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"


@query("""with t as (select case p_partkey % 3 when 0 then 'A' when 1 then 'N' else 'R' end as flag, p_size // 7 * 7 as size, min(p_partkey) as card from part group by all),
n as (select flag, l_quantity, arg_min(card, abs(size - l_quantity) * 1000 + size) as card from (select distinct l_returnflag as flag, l_quantity from lineitem) join t using (flag) group by all)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag as flag, l.l_quantity as quantity, card from lineitem l left join n on n.flag = l.l_returnflag and n.l_quantity = l.l_quantity""")
def nearest_card(spark, sf_dir):
    third = F.col("p_partkey") % 3
    cards = table(spark, sf_dir, "part").select(F.when(third == 0, "A").when(third == 1, "N").otherwise("R").alias("flag"), (F.floor(F.col("p_size") / 7) * 7).cast("double").alias("size"), F.col("p_partkey").alias("card"))
    line = table(spark, sf_dir, "lineitem").select(*_LINE, F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("double").alias("quantity"))
    return J.nearest_row(line, cards, ["flag"], "quantity", "size", "card")


@query("select o_orderpriority, count(*) as windows, cast(sum(o_custkey % 9) as bigint) as rounds, cast(sum(o_orderkey % 50) as bigint) as service_ticks from orders where o_orderstatus in ('F', 'P') group by all")
def strong_decodes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus", (F.col("o_custkey") % 9).alias("rounds"), F.col("o_custkey").alias("start"), (F.col("o_custkey") + F.col("o_orderkey") % 50).alias("done"))
    return R.strong_decodes(o, ["o_orderpriority"], "o_orderstatus", ["F", "P"], "rounds", "start", "done")


@query("select l_orderkey, cast(sum(l_linenumber * 7) as bigint) as one_by_one, cast(max(l_linenumber * 7) as bigint) as together from lineitem group by all")
def batch_prices(spark, sf_dir):
    price = (F.col("l_linenumber") * 7).cast("long")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(A.batch_price("sum", price).alias("one_by_one"), A.batch_price("max", price).alias("together"))


@query("select distinct o_custkey from orders where o_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
def unsettled(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    return M.unsettled(o, o.where("o_orderstatus = 'F'"), "o_custkey")


@query("select o_orderkey, o_custkey % 23 + 1 as rounds, 0 as \"index\", 1 as buffer_lo, 1 as commit_lo, o_custkey % 23 + 1 as commit_hi, o_custkey % 23 + 1 as buffer_hi from orders")
def named_scheme(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 23 + 1).cast("long").alias("rounds"))
    return P.laid(o, "whole_batch", "rounds")


@query(f"select event_id, row_number() over (partition by user_id order by event_id % 97, tick, event_id) as shortest, row_number() over (partition by user_id order by tick + event_id % 1000, tick, event_id) as earliest_deadline from {EVENTS}")
def scheduled(spark, sf_dir):
    out = events(spark, sf_dir)
    for name in ("shortest", "earliest_deadline"):
        out = P.scheduled(out, ["user_id"], name, F.col("tick"), F.col("event_id") % 97, F.col("tick") + F.col("event_id") % 1000, "event_id").withColumnRenamed("turn", name)
    return out.select("event_id", "shortest", "earliest_deadline")


@query("select c_custkey, case when c_custkey % 2 = 0 then c_custkey || '.5' else '\"' || c_custkey || '/11\"' end as number from customer")
def exact_numbers(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    return table(spark, sf_dir, "customer").select("c_custkey", S.json_number(F.concat(key, F.when(F.col("c_custkey") % 2 == 0, ".5").otherwise("/11"))).alias("number"))
