"""Queries of the joins and estimators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspan.functions import estimators as E
from trialspan.functions import scalars as S
from trialspan.operators import joins as J
from trialspan.plans.catalogue import oracle, query
from trialspan.plans.tables import EVENTS, events, table


@query("select o_orderkey, o_custkey, c_mktsegment, c_nationkey from orders join customer on o_custkey = c_custkey where o_totalprice > 100000")
def commit_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_totalprice > 100000").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    return o.join(c, "o_custkey")


@query("select o_orderkey, o_custkey % 5 + 1 as ordinal, l_quantity from orders join lineitem on l_orderkey = o_orderkey and (l_linenumber = o_custkey % 5 + 1 or l_linenumber + 1 = o_custkey % 5 + 1)")
def run_stage_join(spark, sf_dir):
    w = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 5 + 1).alias("ordinal"))
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity", F.array(F.col("l_linenumber").cast("long"), (F.col("l_linenumber") + 1).cast("long")).alias("ordinals"))
    return J.run_stages(w, s, ["o_orderkey"], "ordinal", "ordinals")


@query("select conv_id, turn, unnest(case when turn % 3 = 0 then [turn] else [turn, turn - turn % 3] end) as window from conversations")
def stage_fanout(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("turn").alias("own"), F.array(F.col("turn") - F.col("turn") % 3).alias("others"))
    return J.served(c, "own", "others", "window")


@query("""with q as (select l_orderkey, cast(sum(cast(l_quantity as bigint)) as bigint) as delay from lineitem where l_returnflag = 'R' group by all), m as (select l_orderkey, max(l_linenumber) as last from lineitem where l_linestatus = 'F' group by all)
select o_orderkey, coalesce(delay, 0) as delay, coalesce(last, -1) as last, coalesce(c_nationkey, -1) as nation from orders left join q on q.l_orderkey = o_orderkey left join m on m.l_orderkey = o_orderkey left join (select * from customer where c_acctbal > 0) on c_custkey = o_custkey""")
def points_join(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    q = line.where("l_returnflag = 'R'").groupBy("o_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("delay"))
    m = line.where("l_linestatus = 'F'").groupBy("o_orderkey").agg(F.max("l_linenumber").alias("last"))
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return J.with_defaults(o, [(q, ["o_orderkey"], {"delay": F.lit(0)}), (m, ["o_orderkey"], {"last": F.lit(-1)}), (c, ["o_custkey"], {"nation": F.lit(-1)})]).drop("o_custkey")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def anti_unsaved(spark, sf_dir):
    return J.missing(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("select o_custkey, count(distinct o_orderpriority) as folders from orders group by all having count(distinct o_orderpriority) > 1")
def repeated_shots(spark, sf_dir):
    return J.repeated(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority")


@query("select c_custkey, c_mktsegment from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def semi_known(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(o, "c_custkey", "left_semi")


_WINDOWS = "(select conv_id, w as window, w * 3 + 1 as lo, w * 3 + 5 as hi, w % 2 as depth from (select distinct conv_id from conversations), range(10) t(w))"


def _windows(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return c.withColumn("window", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long")))).withColumns({"lo": F.col("window") * 3 + 1, "hi": F.col("window") * 3 + 5, "depth": F.col("window") % 2})


@query(f"select c.conv_id, c.turn, w.window from conversations c join {_WINDOWS} w on c.conv_id = w.conv_id and c.turn + 1 between w.lo and w.hi")
def range_join(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") + 1).alias("r"))
    return J.range_join(c, _windows(spark, sf_dir), ["conv_id"], "r", "lo", "hi", 4).select("conv_id", "turn", "window")


@query(f"select conv_id, turn from conversations c where exists (select 1 from {_WINDOWS} w where w.conv_id = c.conv_id and w.depth = 1 and c.turn + 1 between w.lo and w.hi)")
def exclusion_semi(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") + 1).alias("r"))
    return J.range_join(c, _windows(spark, sf_dir).where("depth = 1"), ["conv_id"], "r", "lo", "hi", 4, "left_semi").select("conv_id", "turn")


@query(f"select conv_id, turn, owner, ties from (select c.conv_id, c.turn, w.window as owner, count(*) over (partition by c.conv_id, c.turn, w.depth) as ties, row_number() over (partition by c.conv_id, c.turn order by w.depth, w.window) as r from conversations c join {_WINDOWS} w on c.conv_id = w.conv_id and c.turn + 1 between w.lo and w.hi) where r = 1")
def shallowest_owner(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") + 1).alias("r"))
    return J.shallowest_owner(c, _windows(spark, sf_dir), ["conv_id"], "r", "lo", "hi", "window", "depth", 4, "turn").select("conv_id", "turn", F.col("window").alias("owner"), F.col("ties").cast("long").alias("ties"))


_RUN = "(select o_custkey as seed, bool_or(o_totalprice > {}) as failed from orders where o_orderpriority = '{}' group by all)"


def _run(spark, sf_dir, priority, price):
    o = table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == priority)
    return o.groupBy(F.col("o_custkey").alias("seed")).agg(F.bool_or(F.col("o_totalprice") > price).alias("failed"))


@query(f"select count(*) as shots, count(*) filter (where f.failed and not p.failed) as repaired, count(*) filter (where p.failed and not f.failed) as broken, count(*) filter (where p.failed and not s.failed) as missed, count(*) filter (where f.failed and s.failed) as best_of_two from {_RUN.format(250000, '1-URGENT')} f join {_RUN.format(350000, '2-HIGH')} s using (seed) join {_RUN.format(300000, '5-LOW')} p using (seed)")
def three_way_paired(spark, sf_dir):
    j = J.paired(["seed"], fast=_run(spark, sf_dir, "1-URGENT", 250000), strong=_run(spark, sf_dir, "2-HIGH", 350000), pair=_run(spark, sf_dir, "5-LOW", 300000))
    f, s, p = (F.col(f"{n}_failed") for n in ("fast", "strong", "pair"))
    return j.agg(F.count("*").alias("shots"), F.count_if(f & ~p).alias("repaired"), F.count_if(p & ~f).alias("broken"), F.count_if(p & ~s).alias("missed"), F.count_if(f & s).alias("best_of_two"))


@query(f"select count(*) filter (where a.failed and not b.failed) as first_only, count(*) filter (where b.failed and not a.failed) as second_only from {_RUN.format(250000, '1-URGENT')} a join {_RUN.format(300000, '2-HIGH')} b using (seed)")
def mcnemar_counts(spark, sf_dir):
    j = J.paired(["seed"], a=_run(spark, sf_dir, "1-URGENT", 250000), b=_run(spark, sf_dir, "2-HIGH", 300000))
    return j.agg(F.count_if(F.col("a_failed") & ~F.col("b_failed")).alias("first_only"), F.count_if(F.col("b_failed") & ~F.col("a_failed")).alias("second_only"))


@query(f"""with c as ({oracle("mcnemar_counts")}), m as (select *, first_only + second_only as n, least(first_only, second_only) as k from c)
select first_only, second_only, round(least(1.0, 2 * list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))), 9) as p from m""")
def mcnemar_p(spark, sf_dir):
    return mcnemar_counts(spark, sf_dir).withColumn("p", F.round(E.mcnemar_p("first_only", "second_only"), 9))


_FAIL = "(select o_orderpriority as k, o_custkey % 5 * 10 + 5 as rounds, count(*) as n, count(*) filter (where o_orderkey % 11 < 1 + o_custkey % 5 * 0.7) as x from orders group by all)"


def _failures(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("k"), (F.col("o_custkey") % 5 * 10 + 5).alias("rounds")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderkey") % 11 < 1 + F.col("o_custkey") % 5 * 0.7).alias("x"))


@query(f"select k, rounds, round(((x / n) + 3.8416 / (2 * n) - 1.96 * sqrt((x / n) * (1 - x / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 9) as low, round(((x / n) + 3.8416 / (2 * n) + 1.96 * sqrt((x / n) * (1 - x / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 9) as high from {_FAIL}")
def wilson(spark, sf_dir):
    low, high = E.wilson(F.col("x"), F.col("n"))
    return _failures(spark, sf_dir).select("k", "rounds", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query(f"select k, rounds, round((1 - exp(ln(1 - 2 * (x / n)) / rounds)) / 2, 9) as rate from {_FAIL}")
def per_round_rate(spark, sf_dir):
    return _failures(spark, sf_dir).select("k", "rounds", F.round(S.per_round_rate(F.col("x") / F.col("n"), F.col("rounds")), 9).alias("rate"))


@query(f"""with v as (select k, cast(rounds as double) as x, ln(1 - 2 * (x / n)) as y, 1 / (pow(2 / (2 * (x / n) - 1), 2) * (x / n) * (1 - x / n) / n) as w from {_FAIL}),
s as (select k, (sum(w * x * y) - sum(w * x) * sum(w * y) / sum(w)) / (sum(w * x * x) - sum(w * x) * sum(w * x) / sum(w)) as slope, 1 / sqrt(sum(w * x * x) - sum(w * x) * sum(w * x) / sum(w)) as sd from v group by k)
select k, round((1 - exp(slope)) / 2, 8) as rate, round(greatest((1 - exp(slope + 1.96 * sd)) / 2, 0), 8) as low, round((1 - exp(slope - 1.96 * sd)) / 2, 8) as high from s""")
def decay_fit(spark, sf_dir):
    fit = E.decay_fit(_failures(spark, sf_dir), ["k"], "rounds", "x", "n")
    return fit.select("k", *(F.round(c, 8).alias(c) for c in ("rate", "low", "high")))


@query()
def decay_bootstrap(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("k"), (F.col("o_custkey") % 200).alias("stream")).agg(F.count_if(F.col("o_orderkey") % 11 < 1).alias("a"), F.count_if(F.col("o_orderkey") % 11 < 3).alias("b"))
    rows = o.select("k", "stream", F.explode(F.array(F.struct(F.lit(5).alias("rounds"), (F.col("a") > 1).alias("failed")), F.struct(F.lit(15).alias("rounds"), (F.col("b") > 6).alias("failed")))).alias("c")).select("k", "stream", "c.*")
    return E.cluster_bootstrap(rows, ["k"], "stream", "rounds", "failed", 200)


#: A limit is where the chance of at least `least` failures of `shots` is `aim`, found by halving.
@query(f"""with recursive f as (select *, case when rounds > 30 then 'target' else 'cap' end as state from {_FAIL}),
asked as (select k, rounds, 'low' as side, n as shots, x as least, 0.025::double as aim from f where x > 0 union all
select k, rounds, 'high', case when x > 0 and state = 'target' then n - 1 else n end, case when x > 0 and state = 'cap' then x + 1 else greatest(x, 1) end, 0.975 from f where x < n),
halved as (select *, 0.0::double as lo, 1.0::double as hi, 0 as step from asked union all
select k, rounds, side, shots, least, aim, case when tail < aim then (lo + hi) / 2 else lo end, case when tail < aim then hi else (lo + hi) / 2 end, step + 1 from
(select *, list_sum(list_transform(range(least, shots + 1), lambda j: exp(lgamma(shots + 1) - lgamma(j + 1) - lgamma(shots - j + 1) + j * ln((lo + hi) / 2) + (shots - j) * ln(1 - (lo + hi) / 2)))) as tail from halved where step < 50)),
limit_ as (select k, rounds, side, round((lo + hi) / 2, 8) as at from halved where step = 50)
select f.k, f.rounds, f.n, f.x, f.state, case when f.x > 0 then f.x / f.n end as estimate, l.at as low, case when f.x = f.n then 1.0 else h.at end as high
from f left join limit_ l on l.k = f.k and l.rounds = f.rounds and l.side = 'low' left join limit_ h on h.k = f.k and h.rounds = f.rounds and h.side = 'high'""")
def exact_interval(spark, sf_dir):
    rows = _failures(spark, sf_dir).withColumn("state", F.when(F.col("rounds") > 30, "target").otherwise("cap"))
    return E.intervals(rows, "x", "n", "state").withColumns({"low": F.round("low", 8), "high": F.round("high", 8)})


@query(f"select k, rounds, case when rounds > 30 then (x - 1) / (n - 1) else x / n end as estimate, (x + 2) / (n + 2) as bound from {_FAIL}")
def plan_unbiased(spark, sf_dir):
    f = _failures(spark, sf_dir).withColumn("state", F.when(F.col("rounds") > 30, "target").otherwise("cap"))
    return f.select("k", "rounds", E.plan_unbiased(F.col("x"), F.col("n"), F.col("state")).alias("estimate"), E.with_unscored(F.col("x"), F.col("n"), F.lit(2)).alias("bound"))


@query(f"select event_type, round(regr_slope(y, x), 6) as slope, round(regr_intercept(y, x), 6) as intercept, round(regr_r2(y, x), 6) as r2 from (select event_type, event_id % 101 as x, (event_id % 101) * 3 + event_id % 7 as y from {EVENTS}) group by all")
def timing_line(spark, sf_dir):
    e = events(spark, sf_dir).select("event_type", (F.col("event_id") % 101).alias("x"), ((F.col("event_id") % 101) * 3 + F.col("event_id") % 7).alias("y"))
    return e.groupBy("event_type").agg(F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 6).alias("intercept"), F.round(F.regr_r2("y", "x"), 6).alias("r2"))


@query(f"select event_type, round(sum(case when event_id % 4 = 0 and value > 50 then 4.0 else 0 end) / count(*), 9) as bad from {EVENTS} group by all")
def audited_bad_rate(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(F.round(E.inverse_propensity((F.col("event_id") % 4 == 0) & (F.col("value") > 50), F.lit(0.25)), 9).alias("bad"))


@query(f"select a.event_id, b.value as last_value from {EVENTS} a asof join (select user_id, tick, arg_max(value, event_id) as value from {EVENTS} where event_type = 'purchase' group by all) b on a.user_id = b.user_id and a.tick >= b.tick where a.event_type = 'view'")
def asof_last(spark, sf_dir):
    e = events(spark, sf_dir)
    right = e.where("event_type = 'purchase'").groupBy("user_id", "tick").agg(F.max_by("value", "event_id").alias("last_value"))
    return J.asof(e.where("event_type = 'view'").select("event_id", "user_id", "tick"), right, ["user_id"], "tick", "last_value").where("last_value is not null").select("event_id", "last_value")


@query(f"with s as (select user_id as k, event_type as answer, min(value) as w from {EVENTS} group by all), r as (select *, row_number() over (partition by k order by w, answer) as n, lead(w) over (partition by k order by w, answer) as w2, count(*) over (partition by k) as c from s) select k, answer, w2 - w as gap from r where n = 1 and c >= 3")
def gap_consensus(spark, sf_dir):
    s = events(spark, sf_dir).groupBy(F.col("user_id").alias("k"), F.col("event_type").alias("answer")).agg(F.min("value").alias("w"))
    return J.consensus(s, ["k"], "answer", "w", 3)


@query("select o_orderpriority, count(*) as rows, count(*) filter (where (case when o_totalprice > 200000 then 'F' else 'O' end) = o_orderstatus) as agreed, count(*) filter (where (case when o_totalprice > 200000 then 'F' else 'O' end) <> o_orderstatus) as differed from orders group by all")
def posthoc_check(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_orderpriority").agg(*J.checked_answers(o, F.col("o_totalprice") > 200000, F.lit("F"), F.lit("O"), F.col("o_orderstatus")))


@query("select n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey")
def swept_enrichment(spark, sf_dir):
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return table(spark, sf_dir, "nation").join(r, "n_regionkey").select("n_nationkey", "n_name", "r_name")
