"""Queries of scalar expressions, measures and Spark's own window forms over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspan.functions import scalars as S
from trialspan.operators import measures as M
from trialspan.plans.catalogue import query
from trialspan.plans.tables import EVENTS, day, day_sql, events, table


@query(f"select event_id, tick / 1000000.0::double as us, cast(ceil(tick / 7919.0::double) as bigint) * 7919 + 3 * 7919 as edge, cast(ceil(value * 1000 / 64) as bigint) as cycles from {EVENTS}")
def clock_ticks(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select("event_id", S.to_microseconds(F.col("tick")).alias("us"), S.clock_edge(F.col("tick"), 7919, 3).alias("edge"), S.cycles_over(F.col("value") * 1000, 64).alias("cycles"))


@query(f"select event_id, round(value * ln(10) / 10, 9) as nats, floor(value * 10 + 1e-9) / 10 as low from {EVENTS}")
def decibels(spark, sf_dir):
    e = events(spark, sf_dir)
    nats = S.decibels_to_nats(F.col("value"))
    return e.select("event_id", F.round(nats, 9).alias("nats"), S.decibel_bin(nats + 1e-10).alias("low"))


@query("select l_orderkey, l_linenumber, l_partkey, case when l_returnflag = 'R' then 'boundary' else l_linestatus end as hop, case when l_returnflag = 'R' then l_suppkey else l_partkey end as waiting, case when l_returnflag <> 'R' then l_linenumber end as ordinal from lineitem")
def hop_columns(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    source = F.when(F.col("l_returnflag") == "R", F.col("l_orderkey"))
    return line.select("l_orderkey", "l_linenumber", "l_partkey", S.hop(F.col("l_linestatus"), source).alias("hop"), S.waiting_window(F.col("l_linestatus"), source, F.col("l_suppkey"), F.col("l_partkey")).alias("waiting"), S.request_ordinal(source, F.col("l_linenumber")).alias("ordinal"))


@query("select o_orderkey, o_orderpriority from orders where o_orderkey between 100 and 5000 and o_orderstatus = 'F'")
def interval_filter(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(S.within(F.col("o_orderkey"), 100, 5000) & S.holds({"o_orderstatus": "F"})).select("o_orderkey", "o_orderpriority")


@query("select l_orderkey, l_linenumber, sum(case when b > 0 then (ceil(least(32, b) / 4)::bigint * 4 + 24) * 8 end)::bigint as bits, count(*) as frames from (select l_orderkey, l_linenumber, l_partkey, l_suppkey, ceil(l_quantity * 37 / 8)::bigint - (k - 1) * 32 as b from lineitem, range(1, 100) t(k) where k <= greatest(ceil(ceil(l_quantity * 37 / 8) / 32), 1)) group by l_orderkey, l_linenumber, l_partkey, l_suppkey")
def frame_cutting(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").withColumn("f", S.frames("pcie", F.col("l_quantity") * 37, payload=32))
    return line.groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.sum(F.aggregate("f", F.lit(0).cast("long"), lambda a, b: a + b)).alias("bits"), F.sum(F.size("f")).cast("long").alias("frames")).drop("l_partkey", "l_suppkey")


@query("select o_orderkey, greatest(ceil(o_totalprice / 64)::bigint, 1) * 64 as flits, greatest(o_custkey % 64 + 1, 46) * 8 + 38 * 8 as ethernet, (floor(ceil(o_totalprice / 8) / 8)::bigint + 1) * 66 as aurora from orders")
def framings(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice")
    return o.select("o_orderkey", S.frames("flits", price)[0].alias("flits"), S.frames("ethernet", (F.col("o_custkey") % 64 + 1) * 8, payload=1500)[0].alias("ethernet"), S.frames("aurora", price)[0].alias("aurora"))


@query(f"select event_id, event_id % 40 between event_id % 10 and event_id % 30 as covered from {EVENTS}")
def range_cover(spark, sf_dir):
    e = events(spark, sf_dir)
    text = F.concat_ws("..", (F.col("event_id") % 10).cast("string"), (F.col("event_id") % 30).cast("string"))
    return e.select("event_id", S.covers(F.create_map(F.col("event_type"), text), F.col("event_type"), F.col("event_id") % 40).alias("covered"))


@query("select o_orderkey, '{\"c\":' || o_custkey || ',\"k\":' || o_orderkey || '}' as cell from orders")
def json_cell(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.json_cell(F.create_map(F.lit("k"), F.col("o_orderkey"), F.lit("c"), F.col("o_custkey"))).alias("cell"))


@query("select vec_id, array_to_string(list_transform(embedding[1:16], lambda x: cast(x > 0 as int)), '') as bits from embeddings")
def bit_text(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", S.bit_text(F.transform(F.slice("embedding", 1, 16), lambda x: (x > 0).cast("int"))).alias("bits"))


@query("select c_custkey, sha256('{\"c_custkey\":' || c_custkey || ',\"c_mktsegment\":\"' || c_mktsegment || '\"}') as id, 's:' || length(c_mktsegment) || ':' || c_mktsegment as tagged from customer")
def content_ids(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", S.content_id(c_mktsegment=F.col("c_mktsegment"), c_custkey=F.col("c_custkey")).alias("id"), S.identity_bytes(F.lit("s"), F.col("c_mktsegment")).alias("tagged"))


@query("select p_partkey, p_size * 1000.0::double as ticks, (p_size + 0.5) * 1e6 as slow from part")
def unit_texts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", S.unit_value(F.concat(F.col("p_size").cast("string"), F.lit("ns")), "time").alias("ticks"), S.unit_value(F.concat((F.col("p_size") + 0.5).cast("string"), F.lit(" us")), "time").alias("slow"))


@query("select p_partkey, greatest(10.0 + 0.5 * p_size, 30.0)::double as cost, round(0.01 * (1 - p_size / 100.0::double) + p_size / 100.0::double * 0.99, 9) as merged, 2 + 3 + ceil((p_size * 8 + 16) / 64.0::double)::bigint as price from part")
def cost_models(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    lit = lambda v: F.lit(v)
    return p.select("p_partkey", S.floored_line(lit(10.0), lit(0.5), lit(30.0), F.col("p_size")).alias("cost"), F.round(S.merged_probability(lit(0.01), F.col("p_size") / 100.0), 9).alias("merged"), S.link_price(F.col("p_size") * 8, lit(2), lit(64.0), lit(3), lit(16)).cast("long").alias("price"))


@query("select l_linestatus, l_returnflag, count(*) as events, cast(sum(l_linenumber) as bigint) as rounds, cast(sum(cast(l_quantity as bigint)) as bigint) as bits, grouping(l_linestatus, l_returnflag) as level from lineitem group by grouping sets ((l_linestatus), (l_returnflag), ())")
def movement_tallies(spark, sf_dir):
    moves = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_returnflag", F.col("l_linenumber").alias("rounds"), F.col("l_quantity").cast("long").alias("bits"))
    return M.movement_tallies(moves, "l_linestatus", "l_returnflag")


@query(f"select l_linestatus, l_suppkey % 20 as w, '' || (l_linenumber % 2) as hop, max(d + l_linenumber) - min(d) as span, cast(sum(l_linenumber) as bigint) as delay, max(d + l_linenumber) as landed, min(d) as first_start from (select *, {day_sql('l_shipdate')} as d from lineitem) group by all")
def hop_spans(spark, sf_dir):
    d = day("l_shipdate").cast("long")
    t = table(spark, sf_dir, "lineitem").select("l_linestatus", (F.col("l_suppkey") % 20).alias("w"), (F.col("l_linenumber") % 2).cast("string").alias("hop"), d.alias("request"), (d + F.col("l_linenumber")).alias("delivery"), F.col("l_linenumber").alias("total_delay"))
    return M.link_spans(t, ["l_linestatus", "w"])


@query(f"with m as (select l_suppkey as k, d as t, 1 as x from (select *, {day_sql('l_shipdate')} as d from lineitem) union all select l_suppkey, d + cast(l_quantity as bigint), -1 from (select *, {day_sql('l_shipdate')} as d from lineitem)), h as (select *, sum(x) over (partition by k order by t, x rows unbounded preceding) as held from m) select k, count(*) filter (where x = 1 and held > 8) as over from h group by k")
def capacity_stalls(spark, sf_dir):
    d = day("l_shipdate").cast("long")
    t = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), d.alias("a"), (d + F.col("l_quantity").cast("long")).alias("b"))
    return M.capacity_stalls(t, ["k"], "a", "b", 8)


@query(f"select event_id, event_type from {EVENTS} where event_type = 'click' and (user_id = 7 or (event_id % 50 <= 7 and 7 <= event_id % 50 + 3))")
def trace_follow(spark, sf_dir):
    kind, low = F.col("event_type"), F.col("event_id") % 50
    text = lambda *parts: F.concat_ws(":", *(p.cast("string") for p in parts))
    covered = F.concat(kind, F.lit(":"), low.cast("string"), F.lit(".."), (low + 3).cast("string"))
    args = F.create_map(F.lit("round"), text(kind, F.col("user_id")), F.lit("request"), text(kind, F.col("user_id"), F.col("event_id")), F.lit("rounds"), covered)
    trace = events(spark, sf_dir).select("event_id", "event_type", F.col("tick").alias("ts"), F.col("user_id").alias("tid"), F.col("event_id").alias("place"), args.alias("args"))
    return M.follow(trace, "round", "click:7").select("event_id", "event_type")


@query(f"with r as (select tick, user_id, event_id, sum(cast(coalesce(tick - p >= 1800000000, true) as int)) over (partition by user_id order by tick, event_id rows unbounded preceding) as s from (select *, lag(tick) over (partition by user_id order by tick, event_id) as p from {EVENTS})) select user_id, min(tick) as start, max(tick) + 1800000000 as end, count(*) as n from r group by user_id, s")
def session_window(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("t"))
    g = e.groupBy("user_id", F.session_window("t", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.unix_micros("w.start").alias("start"), F.unix_micros("w.end").alias("end"), "n")


@query("select s as start, event_type, count(*) as n from (select (epoch_us(ts) // 1800000000 - k) * 1800 as s, event_type from events, (values (0), (1)) v(k)) group by all")
def hop_window(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("t"))
    g = e.groupBy("event_type", F.window("t", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return g.select(F.unix_seconds("w.start").alias("start"), "event_type", "n")


@query("select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)")
def flag_cube(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query()
def approx_users(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"))
