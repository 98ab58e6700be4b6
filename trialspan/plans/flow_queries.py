"""Queries of orders, hand-offs, releases, controllers and statistics over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspan.operators import flows as L
from trialspan.operators import folds
from trialspan.operators import graph as G
from trialspan.plans.catalogue import query
from trialspan.plans.tables import EVENTS, events, table


@query("select l_orderkey, l_linenumber, l_suppkey, l_partkey from lineitem")
def ordered_merge(spark, sf_dir):
    return L.merged(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"), "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")


@query(f"select event_id from (select event_id, value, lag(value) over (partition by user_id order by event_id) as before from {EVENTS}) where before > value")
def out_of_order(spark, sf_dir):
    return L.out_of_order(events(spark, sf_dir).select("event_id", "user_id", "value"), "user_id", "event_id", ["value"]).select("event_id")


@query("select conv_id, turn, coalesce(bit_xor(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)::bigint as boundary from conversations")
def boundary_carry(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("residual"))
    return L.carried(c, ["conv_id"], "turn", "residual").select("conv_id", "turn", "boundary")


@query("select l_orderkey, l_linenumber, l_partkey, greatest(l_suppkey, l_partkey % 100) as held, l_suppkey as eager, l_returnflag = 'R' and l_partkey % 100 > l_suppkey as redone from lineitem")
def boundary_policies(spark, sf_dir):
    p, f, d = F.col("l_suppkey"), F.col("l_partkey") % 100, F.col("l_returnflag") == "R"
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", L.boundary_emits("held", p, f, d)[0].alias("held"), L.boundary_emits("eager", p, f, d)[0].alias("eager"), L.boundary_emits("checked", p, f, d)[1].alias("redone"))


@query("with w as (select o_orderkey, o_custkey % 3 as answer from orders), s as (select l_orderkey as o_orderkey, min(l_linenumber) % 3 as a from lineitem where l_returnflag = 'R' group by all) select o_orderkey, answer, coalesce(a, answer) as final, coalesce(a <> answer, false) as revised from w left join s using (o_orderkey)")
def confidence_revised(spark, sf_dir):
    w = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 3).alias("answer"))
    s = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.min("l_linenumber") % 3).cast("long").alias("answer"))
    return L.revised(w, s, ["o_orderkey"], "answer")


@query("select o_orderkey, max(p_size) as last_send from (select o_orderkey, unnest([o_custkey % 50, o_custkey % 70, o_orderkey % 90]) as p_partkey from orders) join part using (p_partkey) group by all")
def last_required_send(spark, sf_dir):
    w = table(spark, sf_dir, "orders").select("o_orderkey", F.array(F.col("o_custkey") % 50, F.col("o_custkey") % 70, F.col("o_orderkey") % 90).alias("reads"))
    return L.last_send(w, table(spark, sf_dir, "part"), ["o_orderkey"], "reads", "p_partkey", "p_size")


@query("select a.conv_id, a.turn, b.turn as partner_turn, length(b.text) as partner_bits from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 2")
def region_coupling(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("bits"))
    return L.coupled(c, ["conv_id"], "turn", 2).select("conv_id", "turn", "partner_turn", "partner_bits")


@query("select distinct p_brand as kind, l_partkey as row, l_suppkey as col from lineitem join part on p_partkey = l_partkey")
def basis_split(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col"))
    return L.split_by_basis(e, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row"), F.col("p_brand").alias("kind")), "row", "col", "kind")


@query("select l_partkey, l_suppkey, l_orderkey from lineitem where l_partkey in (select p_partkey from part where p_size < 20) and l_suppkey in (select s_suppkey from supplier where s_acctbal > 0)")
def link_projection(spark, sf_dir):
    links = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey")
    a = table(spark, sf_dir, "part").where("p_size < 20").select(F.col("p_partkey").alias("l_partkey"))
    return L.projected(links, a, table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey")), "l_partkey", "l_suppkey")


_UP = "(select p_partkey as child, p_partkey // 2 as parent from part where p_partkey > 1)"


@query(f"with recursive c as (select child, parent as up from {_UP} union all select c.child, t.parent from c join {_UP} t on t.child = c.up), w as (select child, max(p_size) as m, bool_or(p_size is null) as o from c left join (select * from part where p_size > 2) p on p.p_partkey = c.up group by child) select p_partkey, case when not coalesce(o, false) then greatest(p_size, coalesce(m, p_size)) end as usable from part left join w on child = p_partkey where p_size > 2")
def release_rules(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    tree = part.where("p_partkey > 1").select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 2).alias("parent"))
    return L.usable(G.closure(tree, "child", "parent"), part.where("p_size > 2").select("p_partkey", "p_size"), "p_partkey", "p_size")


@query("select o_orderkey, greatest(c, s) as released from orders join (select l_orderkey as o_orderkey, max(l_suppkey) as c from lineitem where l_returnflag = 'R' group by all) using (o_orderkey) join (select l_orderkey as o_orderkey, max(l_partkey) as s from lineitem where l_linestatus = 'F' group by all) using (o_orderkey)")
def pending_release(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    c = line.where("l_returnflag = 'R'").groupBy("o_orderkey").agg(F.max("l_suppkey").alias("committed"))
    return L.pending(table(spark, sf_dir, "orders"), c, line.where("l_linestatus = 'F'").groupBy("o_orderkey").agg(F.max("l_partkey").alias("stored")), "o_orderkey")


@query(f"select event_id from (select event_id, tick, min(case when event_id > 5000 then tick end) over (partition by user_id) as b from {EVENTS}) where tick >= b")
def region_of_interest(spark, sf_dir):
    return L.past_warmup(events(spark, sf_dir), ["user_id"], "event_id", "tick", 5000).select("event_id")


@query("select conv_id, turn, case when length(text) % 4 > 0 then role else 'unread' end as status from conversations")
def unread_remainder(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return L.with_remainder(c.where(F.length("text") % 4 > 0).select("conv_id", "turn", F.col("role").alias("status")), c, ["conv_id", "turn"], "status")


@query(f"""with recursive e as (select user_id, row_number() over (partition by user_id order by event_id) as n, value as g, event_id % 3 = 0 as b from {EVENTS}),
r as (select user_id, 0::bigint as n, 20.0::double as theta, 0.2::double as target, 0 as kept, 0 as audits, 0 as bad from (select distinct user_id from e) union all
select user_id, n, theta2, case when audited then greatest(0, least(1, target + case when bad2 > audits2 * 0.3 then 0.01 else -0.01 end)) else target end, kept2, audits2, bad2 from
(select *, audits + cast(audited as int) as audits2, bad + cast(audited and b as int) as bad2 from (select *, not up and kept2 % 4 = 0 as audited from
(select e.user_id, e.n, e.b, e.g < r.theta as up, r.theta + 0.5 * (r.target - cast(e.g < r.theta as int)) as theta2, r.target, r.kept + cast(e.g >= r.theta as int) as kept2, r.audits, r.bad from r join e on e.user_id = r.user_id and e.n = r.n + 1))))
select user_id, round(arg_max(theta, n), 8) as threshold, round(arg_max(target, n), 8) as target, arg_max(bad, n) as audited_bad from r group by all""")
def online_controller(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("bad", F.col("event_id") % 3 == 0)
    out = folds.online_controller(e, ["user_id"], "event_id", "value", "bad", 0.2, 20.0, 0.5, 4, 0.01, 0.3)
    return out.withColumns({"threshold": F.round("threshold", 8), "target": F.round("target", 8)})


@query("""select l_linestatus, 'link' as path, 'returned' as statistic, 'count' as field, count(*) filter (where l_returnflag = 'R') as value from lineitem group by all
union all select l_linestatus, 'link', 'delay', field, v from (select l_linestatus, count(*) as count, cast(sum(l_linenumber) as bigint) as sum, min(l_linenumber)::bigint as minimum, max(l_linenumber)::bigint as maximum from lineitem where l_quantity > 10 group by all) unpivot (v for field in (count, sum, minimum, maximum))""")
def declared_statistics(spark, sf_dir):
    declared = [L.Statistic("link", "returned", "count", F.col("l_returnflag") == "R"), L.Statistic("link", "delay", "distribution", F.col("l_quantity") > 10, F.col("l_linenumber"))]
    return L.statistics(table(spark, sf_dir, "lineitem"), ["l_linestatus"], declared)
