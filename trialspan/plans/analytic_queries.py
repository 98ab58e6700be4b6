"""Queries of the analytic and set operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspan.operators import aggregates as A
from trialspan.operators import analytic as W
from trialspan.operators import folds, scans, sets
from trialspan.plans.catalogue import oracle, query
from trialspan.plans.tables import EVENTS, day, day_sql, events, table


@query("""with r as (select o_custkey % 100 as task, row_number() over (partition by o_custkey % 100 order by o_orderkey) - 1 as n0, o_orderkey, o_totalprice, o_orderstatus from orders),
s as (select task, n0 + cast(task % 7 = 3 and n0 > 40 as int) as seed, o_totalprice > 300000 as failed, o_orderstatus <> 'P' as scored from r),
g as (select *, row_number() over (partition by task order by seed) as n from s), p as (select *, cast(failed and scored as int) as f, cast(scored as int) as sc from g where seed = n - 1),
c as (select *, sum(f) over w as failures, sum(sc) over w as scored_n from p window w as (partition by task order by seed rows unbounded preceding)),
t as (select *, case when failures >= 12 and scored_n >= 40 then case when scored_n = 40 then 'minimum' else 'target' end when n >= 120 then 'cap' end as state from c),
l as (select *, coalesce(min(case when state is not null then n end) over (partition by task), 2147483647) as stop from t)
select task, max(n) as shots, cast(arg_max(scored_n, n) as bigint) as scored, cast(arg_max(failures, n) as bigint) as failures, coalesce(max(case when n = stop then state end), 'running') as state from l where n <= stop group by task""")
def prefix_stop(spark, sf_dir):
    from pyspark.sql import Window

    task = F.col("o_custkey") % 100
    o = table(spark, sf_dir, "orders").withColumn("task", task)
    n0 = F.row_number().over(Window.partitionBy("task").orderBy("o_orderkey")) - 1
    o = o.withColumn("n0", n0).withColumn("seed", F.col("n0") + ((F.col("task") % 7 == 3) & (F.col("n0") > 40)).cast("int"))
    return W.prefix_stop(o, "task", "seed", F.col("o_totalprice") > 300000, F.col("o_orderstatus") != "P", target=12, minimum=40, cap=120)


@query(f"select user_id, greatest(coalesce(max(case when event_type = 'purchase' then tick end) - min(case when event_type = 'view' then tick end), 0), 0) as stall from {EVENTS} group by all")
def stall_pairing(spark, sf_dir):
    return W.paired_delay(events(spark, sf_dir), ["user_id"], "event_type", "tick", "view", "purchase")


_LEVEL = f"""with l as (select user_id, tick // 1000000 as s, arg_max(cast(floor(value) as bigint), event_id) as level from {EVENTS} group by all), h as (select *, lead(s) over (partition by user_id order by s) as u from l)"""


@query(f"{_LEVEL} select user_id, cast(sum(level * greatest(coalesce(u, s) - s, 0)) as bigint) as area, cast(sum(greatest(coalesce(u, s) - s, 0)) as bigint) as span, max(level) as peak, sum(level * greatest(coalesce(u, s) - s, 0)) / nullif(sum(greatest(coalesce(u, s) - s, 0)), 0) as mean from h group by all")
def level_time_mean(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", F.floor(F.col("tick") / 1000000).alias("s"), "event_id", F.floor("value").alias("level"))
    return W.level_summary(e, ["user_id"], "s", "event_id", "level")


@query(f"{_LEVEL}, m as (select (min(tick // 1000000) + max(tick // 1000000)) // 2 as reset_at from {EVENTS}) select user_id, cast(sum(level * greatest(coalesce(u, s) - greatest(s, reset_at), 0)) as bigint) as area, cast(sum(greatest(coalesce(u, s) - greatest(s, reset_at), 0)) as bigint) as span, max(case when greatest(coalesce(u, s) - greatest(s, reset_at), 0) > 0 or u is null then level end) as peak from h, m group by all")
def level_reset(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", F.floor(F.col("tick") / 1000000).alias("s"), "event_id", F.floor("value").alias("level"))
    at = e.agg(F.floor((F.min("s") + F.max("s")) / 2)).head()[0]
    return W.level_summary(e, ["user_id"], "s", "event_id", "level", start=F.lit(at)).drop("mean")


@query(f"select user_id, count(*) as points, first(tick order by tick, event_id) as first_tick, last(event_id order by tick, event_id) as last_event from {EVENTS} group by all")
def history_series(spark, sf_dir):
    h = W.history(events(spark, sf_dir), ["user_id"], "tick", "event_id", "event_id")
    return h.select("user_id", F.size("series").cast("long").alias("points"), F.col("series")[0]["tick"].alias("first_tick"), F.element_at("series", -1)["level"].alias("last_event"))


_SPANS = f"(select l_suppkey, {day_sql('l_shipdate')} as a, {day_sql('l_shipdate')} + cast(l_quantity as bigint) as b from lineitem)"


@query(f"with m as (select l_suppkey, a as t, 1 as d from {_SPANS} union all select l_suppkey, b, -1 from {_SPANS}), n as (select l_suppkey, t, sum(d) as d from m group by all), r as (select *, sum(d) over (partition by l_suppkey order by t rows unbounded preceding) as now from n) select l_suppkey, cast(max(now) as bigint) as peak from r group by all")
def sweep_line_peak(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", day("l_shipdate").cast("long").alias("a")).withColumn("b", F.col("a"))
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", day("l_shipdate").cast("long").alias("a"), (day("l_shipdate") + F.col("l_quantity").cast("long")).alias("b"))
    return W.sweep_line_peak(line, ["l_suppkey"], "a", "b")


_OK = "(select conv_id, turn + 1 as r, length(text) % 5 <> 0 as ok from conversations)"


@query(f"with g as (select distinct conv_id, r from {_OK} where ok), i as (select conv_id, r - row_number() over (partition by conv_id order by r) as island from g) select c.conv_id, count(island) as unbroken from (select distinct conv_id from conversations) c left join (select * from i where island = 0) i using (conv_id) group by all")
def unbroken_prefix(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("r"), (F.length("text") % 5 != 0).alias("ok"))
    return W.unbroken_prefix(c, ["conv_id"], "r", F.col("ok"))


@query("""with d as (select lang, doc_id, case when n_chars % 11 = 0 then null else n_chars % 3 = 0 end as failed from documents), c as (select *, row_number() over w = 1 or coalesce(not lag(failed) over w, false) as counted from d window w as (partition by lang order by doc_id))
select lang, count(*) filter (where counted) as counted, count(*) filter (where counted and failed) as failures from c group by all""")
def past_passed_gate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", "doc_id", F.when(F.col("n_chars") % 11 != 0, F.col("n_chars") % 3 == 0).alias("failed"))
    return W.past_passed(d, ["lang"], "doc_id", "failed").groupBy("lang").agg(F.count_if("counted").alias("counted"), F.count_if(F.col("counted") & F.coalesce("failed", F.lit(False))).alias("failures"))


@query(f"select user_id, event_id, event_id - lag(event_id, 1, 0) over (partition by user_id order by event_id) as event_id_step from {EVENTS}")
def running_diff(spark, sf_dir):
    return W.running_difference(events(spark, sf_dir).select("user_id", "event_id"), ["user_id"], "event_id", ["event_id"])


@query(f"with r as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as n from {EVENTS}) select user_id, coalesce(max(n) filter (where event_id <= 5000), 0) as before, max(n) - coalesce(max(n) filter (where event_id <= 5000), 0) as after from r group by all")
def split_at(spark, sf_dir):
    from pyspark.sql import Window

    e = events(spark, sf_dir).select("user_id", "event_id").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long"))
    return W.split_at(e, ["user_id"], "event_id", "n", F.lit(5000))


@query(f"with r as (select event_type, event_id, (row_number() over (partition by event_type order by event_id) - 1) // 100 as block from {EVENTS}) select event_type, block, count(*) as rows, avg(event_id) as mean from r group by all")
def count_blocks(spark, sf_dir):
    return W.count_blocks(events(spark, sf_dir), ["event_type"], ["event_id"], 100, F.col("event_id"))


@query(f"with r as (select event_type, row_number() over w as rows, cast(sum(cast(value > 20 as int)) over w as bigint) as flagged from {EVENTS} window w as (partition by event_type order by event_id rows unbounded preceding)) select * from r where rows % 100 = 0")
def every_kth(spark, sf_dir):
    return W.every_kth(events(spark, sf_dir), ["event_type"], ["event_id"], 100, F.col("value") > 20)


@query(f"with e as (select user_id, event_id, tick, cast(value * 1000000 as bigint) as s from {EVENTS}), c as (select *, sum(s) over w as cum from e window w as (partition by user_id order by tick, event_id rows unbounded preceding)), f as (select *, max(tick - (cum - s)) over (partition by user_id order by tick, event_id rows unbounded preceding) + cum as fin from c) select event_id, cast(fin - s as bigint) as start, cast(fin as bigint) as end, cast(fin + 29 as bigint) as landed from f")
def serial_channel(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("s", F.round(F.col("value") * 1000000).cast("long"))
    return W.serial_channel(e, ["user_id"], ["tick", "event_id"], "tick", "s", 29).select("event_id", "start", "end", "landed")


@query(f"""with recursive e as (select user_id, row_number() over (partition by user_id order by event_id) as n, value as g from {EVENTS}), r as (select user_id, n, 20.0::double + 0.5 * (0.2 - cast(g < 20.0 as int)) as theta, cast(g < 20.0 as int) as k from e where n = 1
union all select e.user_id, e.n, r.theta + 0.5 * (0.2 - cast(e.g < r.theta as int)), r.k + cast(e.g < r.theta as int) from r join e on e.user_id = r.user_id and e.n = r.n + 1)
select user_id, round(arg_max(theta, n), 9) as threshold, cast(arg_max(k, n) as bigint) as escalated from r group by all""")
def adaptive_threshold(spark, sf_dir):
    return folds.adaptive_threshold(events(spark, sf_dir), ["user_id"], "event_id", "value", 0.2, 20.0, 0.5).withColumn("threshold", F.round("threshold", 9))


@query(f"""with recursive b0 as (select event_type, (row_number() over (partition by event_type order by event_id) - 1) // 25 as block, cast(value as bigint) as v from {EVENTS}), b as (select event_type, block, avg(v) as mean from b0 group by all having count(*) = 25),
f as (select event_type, row_number() over (partition by event_type order by block) as n, coalesce(mean > lag(mean) over w and lag(mean) over w > lag(mean, 2) over w and mean - lag(mean, 2) over w > 1.0, false) as rise, coalesce(mean <= lag(mean, 3) over w, false) as calm from b window w as (partition by event_type order by block)),
r as (select event_type, 0 as n, 0 as level, 0 as since from (select distinct event_type from f) union all select f.event_type, f.n::int, r.level + case when rise then -1 when since + 1 >= 3 and calm then 1 else 0 end, case when rise or (since + 1 >= 3 and calm) then 0 else since + 1 end from r join f on f.event_type = r.event_type and f.n = r.n + 1)
select event_type, arg_max(level, n) as level from r group by all""")
def controller_steps(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("v", F.rint("value").cast("long"))
    return folds.target_steps(e, ["event_type"], ["event_id"], "v", 25, 2, 3, 1.0)


@query(f"select user_id, event_type, event_id, rank from (select user_id, event_type, event_id, event_id % 5 as rank, row_number() over (partition by user_id, event_type order by event_id % 5, event_id desc) as r from {EVENTS}) where r = 1")
def keep_best_revision(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "event_type", "event_id", (F.col("event_id") % 5).alias("rank"))
    return W.best_revision(e, ["user_id", "event_type"], "rank", "event_id")


@query("with s as (select l_orderkey as k, l_linenumber as ordinal, min(cast(l_quantity as bigint)) as dispatch, min(l_suppkey % 30) as released from lineitem group by all), c as (select k, min(case when ordinal % 3 <> 0 and dispatch >= released then dispatch end) as best, min(dispatch) as fallback from s group by all) select k, coalesce(best, fallback) as first_dispatch from c")
def first_dispatch(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ordinal")).agg(F.min(F.col("l_quantity").cast("long")).alias("dispatch"), F.min(F.col("l_suppkey") % 30).alias("released"))
    cancelled = spark.range(1, 8).where("id % 3 = 0").select(F.col("id").cast("int").alias("ordinal"))
    return W.first_dispatch(s, cancelled, "k", "ordinal", "dispatch", "released", "dispatch")


@query(f"select event_id, row_number() over (partition by user_id order by event_type, tick, event_id) as turn from {EVENTS}")
def scheduler_rank(spark, sf_dir):
    return W.ranked(events(spark, sf_dir), ["user_id"], ["event_type", "tick", "event_id"]).select("event_id", F.col("turn").cast("long"))


@query("""with p as (select o_orderpriority, o_orderstatus, cast(count(*) as double) as y, row_number() over (partition by o_orderpriority order by o_orderstatus) as x from orders group by o_orderpriority, o_orderstatus), l as (select o_orderpriority, x, y, lead(x) over w as x1, lead(y) over w as y1 from p window w as (partition by o_orderpriority order by x))
select o_orderpriority, y + (1.5 - x) / (x1 - x) * (y1 - y) as y from l where x <= 1.5 and 1.5 <= x1""")
def interp(spark, sf_dir):
    from pyspark.sql import Window

    p = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").cast("double").alias("y")).withColumn("x", F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderstatus")))
    return W.interpolated(p, ["o_orderpriority"], "x", "y", F.lit(1.5))


_SEEDS = "(select distinct o_custkey as seed from orders where o_orderpriority = '{}')"


@query("select o_orderkey, o_custkey, null::bigint as l_suppkey from orders union all select l_orderkey, null, l_suppkey from lineitem")
def union_by_name(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return sets.union(a, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey"))


@query(f"select seed from {_SEEDS.format('1-URGENT')} intersect select seed from {_SEEDS.format('2-HIGH')} intersect select seed from {_SEEDS.format('5-LOW')}")
def seed_intersection(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "seed")
    return sets.shared_keys("seed", *(o.where(F.col("o_orderpriority") == p) for p in ("1-URGENT", "2-HIGH", "5-LOW")))


@query(f"select seed from {_SEEDS.format('1-URGENT')} except select seed from {_SEEDS.format('2-HIGH')}")
def seed_difference(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "seed")
    return sets.only_in(o.where("o_orderpriority = '1-URGENT'"), o.where("o_orderpriority = '2-HIGH'"), "seed")


_RANGES = f"(select l_suppkey, {day_sql('l_shipdate')} as lo, {day_sql('l_shipdate')} + 1 + l_linenumber % 3 as hi from lineitem)"


@query(f"with b as (select *, max(hi) over (partition by l_suppkey order by lo, hi rows between unbounded preceding and 1 preceding) as p from {_RANGES}), i as (select *, sum(cast(p is null or p < lo as int)) over (partition by l_suppkey order by lo, hi rows unbounded preceding) as island from b) select l_suppkey, min(lo) as lo, max(hi) as hi from i group by l_suppkey, island")
def interval_union(spark, sf_dir):
    return sets.joined_intervals(_ranges(spark, sf_dir), ["l_suppkey"], "lo", "hi")


def _ranges(spark, sf_dir):
    d = day("l_shipdate")
    return table(spark, sf_dir, "lineitem").select("l_suppkey", d.cast("long").alias("lo"), (d + 1 + F.col("l_linenumber") % 3).cast("long").alias("hi"))


@query(f"with b as (select l_suppkey, lo, max(hi) over (partition by l_suppkey order by lo, hi rows unbounded preceding) as hi from {_RANGES}), g as (select l_suppkey, greatest(hi, 9000) as lo, least(coalesce(lead(lo) over (partition by l_suppkey order by lo, hi), 11000), 11000) as hi from b union all select l_suppkey, 9000, least(min(lo), 11000) from b group by l_suppkey) select distinct l_suppkey, lo, hi from g where lo < hi")
def interval_difference(spark, sf_dir):
    return sets.interval_gaps(_ranges(spark, sf_dir), ["l_suppkey"], "lo", "hi", F.lit(9000).cast("long"), F.lit(11000).cast("long"))


@query("select row_number() over (order by a, b, c) - 1 as cell, a, b, c from (values (3), (5), (7)) t(a), (values (0.001), (0.002)) u(b), (values ('x'), ('y')) v(c)")
def grid(spark, sf_dir):
    return sets.grid(spark, {"a": [3, 5, 7], "b": [0.001, 0.002], "c": ["x", "y"]})


@query("select r_regionkey, cast(r_regionkey * 1000 // 5 as bigint) + 1 as lo, cast((r_regionkey + 1) * 1000 // 5 as bigint) as hi from region")
def balanced_share(spark, sf_dir):
    low, high = sets.share(F.lit(1), F.lit(1000), F.col("r_regionkey"), 5)
    return table(spark, sf_dir, "region").select("r_regionkey", low.cast("long").alias("lo"), high.cast("long").alias("hi"))


@query("with r as (select conv_id, turn, bit, turn = coalesce(lag(turn) over (partition by conv_id order by turn) + 1, turn) as ok, max(turn) over (partition by conv_id) as last from (select conv_id, turn, length(text) % 8 as bit from conversations)) select conv_id, bool_and(ok) and min(turn) = 0 as tiles, bit_xor(bit) as folded from r group by all")
def tiling_check(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("lo"), F.col("turn").alias("hi"), (F.length("text") % 8).cast("long").alias("bit"))
    last = c.groupBy("conv_id").agg(F.max("hi").alias("last"))
    return sets.tiling(c.join(last, "conv_id"), ["conv_id"], "lo", "hi", F.lit(0).cast("long"), F.col("last"), "bit")


#: Rows of a block in the queries below: small, so that every key has many.
_ROWS = 700


@query(oracle("level_time_mean"))
def blocked_level(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", F.floor(F.col("tick") / 1000000).alias("s"), "event_id", F.floor("value").alias("level"))
    return scans.level_summary(e, ["user_id"], "s", "event_id", "level", rows=_ROWS)


@query(oracle("sweep_line_peak"))
def blocked_sweep_line(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", day("l_shipdate").cast("long").alias("a"), (day("l_shipdate") + F.col("l_quantity").cast("long")).alias("b"))
    return scans.sweep_line_peak(line, ["l_suppkey"], "a", "b", rows=_ROWS)


@query(oracle("serial_channel"))
def blocked_serial_channel(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("s", F.round(F.col("value") * 1000000).cast("long"))
    return scans.serial_channel(e, ["user_id"], ["tick", "event_id"], "tick", "s", 29, rows=_ROWS).select("event_id", "start", "end", "landed")


@query(oracle("asof_last"))
def blocked_asof(spark, sf_dir):
    e = events(spark, sf_dir)
    right = e.where("event_type = 'purchase'").groupBy("user_id", "tick").agg(F.max_by("value", "event_id").alias("last_value"))
    return scans.asof(e.where("event_type = 'view'").select("event_id", "user_id", "tick"), right, ["user_id"], "tick", "last_value", rows=_ROWS).where("last_value is not null").select("event_id", "last_value")


@query(oracle("nearest_percentile"))
def blocked_percentile(spark, sf_dir):
    counts = A.value_counts(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")
    return scans.nearest_percentile(counts, ["l_returnflag"], "l_quantity", {"p50": 0.5, "p90": 0.9}, rows=20)


@query(f"select event_id, cast(sum(event_id) over w as bigint) as total, max(value) over w as high from {EVENTS} window w as (partition by event_type order by tick, event_id rows unbounded preceding)")
def blocked_running(spark, sf_dir):
    e = events(spark, sf_dir)
    return scans.running(e, ["event_type"], ["tick", "event_id"], {"total": "event_id"}, {"high": "value"}, rows=_ROWS).select("event_id", "total", "high")
