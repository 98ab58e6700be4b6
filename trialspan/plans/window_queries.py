"""Queries of the round windows over the driver's tables: a conversation is a stream, a turn a round."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspan.operators import windows as R
from trialspan.plans.catalogue import query
from trialspan.plans.tables import EVENTS, day_sql, events, table

_STREAMS = "(select conv_id, count(*) * 4 + conv_id % 7 as n from conversations group by conv_id)"
_OUT = ["conv_id", "index", "buffer_lo", "commit_lo", "commit_hi", "buffer_hi"]


def _streams(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.count("*") * 4 + F.first("conv_id") % 7).alias("n"))


@query(f"with recursive w as (select conv_id, n, 0 as index, 1 as lo from {_STREAMS} union all select conv_id, n, index + 1, lo + 3 from w where n - lo + 1 >= 8) select conv_id, index::bigint as index, lo::bigint as buffer_lo, lo::bigint as commit_lo, case when n - lo + 1 >= 8 then lo + 2 else n end as commit_hi, case when n - lo + 1 >= 8 then lo + 4 else n end as buffer_hi from w")
def sliding_flush(spark, sf_dir):
    return R.sliding_flush(_streams(spark, sf_dir), "n", 3, 2).select(*_OUT)


@query(f"select conv_id, i as index, i * 3 + 1 as buffer_lo, i * 3 + 1 as commit_lo, least((i + 1) * 3, n) as commit_hi, least((i + 1) * 3, n) + 2 as buffer_hi from {_STREAMS}, range(1000) t(i) where i < greatest(ceil(n / 3), 1)")
def sliding_lookahead(spark, sf_dir):
    return R.sliding_lookahead(_streams(spark, sf_dir), "n", 3, 2).select(*_OUT)


@query(f"select conv_id, 0::bigint as index, 1::bigint as buffer_lo, 1::bigint as commit_lo, n as commit_hi, n as buffer_hi from {_STREAMS}")
def whole_batch(spark, sf_dir):
    return R.whole_batch(_streams(spark, sf_dir), "n").select(*_OUT)


@query(f"""with recursive w as (select conv_id, n, 0 as index, 'A' as kind, 1 as blo, 1 as clo, least(4, n) as chi, least(6, n) as bhi, n - least(4, n) as r from {_STREAMS}
union all select conv_id, n, index + 1, case when kind = 'A' then 'B' else 'A' end,
case when kind = 'A' then chi + 1 else chi + 1 - 2 end, chi + 1, case when kind = 'A' then least(chi + 6, n) else least(chi + 2, n) end, case when kind = 'A' then least(chi + 6, n) else least(least(chi + 2, n) + 2, n) end,
case when kind = 'A' then n - least(chi + 6, n) else n - least(chi + 2, n) end from w where (kind = 'A' and r > 2) or (kind = 'B' and r > 0))
select conv_id, index::bigint as index, kind, blo::bigint as buffer_lo, clo::bigint as commit_lo, (case when kind = 'A' and r <= 2 then n else chi end)::bigint as commit_hi, (case when kind = 'A' and r <= 2 then n else bhi end)::bigint as buffer_hi from w""")
def block_ab(spark, sf_dir):
    return R.block_ab(_streams(spark, sf_dir), "n", 2).select(*_OUT, "kind")


@query(f"""with c as (select *, greatest(ceil((n - 9) / 5)::bigint + 1, 1) as cores from {_STREAMS}), w as (select conv_id, n, cores, i as index, i // 2 as k from c, range(2000) t(i) where i < 2 * cores - 1)
select conv_id, index, case when index % 2 = 0 then 1 + k * 5 else 7 + k * 5 end as buffer_lo, case when index % 2 = 1 then 7 + k * 5 when k = 0 then 1 else 3 + k * 5 end as commit_lo,
case when index % 2 = 1 then 7 + k * 5 when k = cores - 1 then n else least(6 + k * 5, n) end as commit_hi, case when index % 2 = 1 then 7 + k * 5 else least(n, k * 5 + 9) end as buffer_hi from w""")
def sandwich(spark, sf_dir):
    return R.sandwich(_streams(spark, sf_dir), "n", 5, 2).select(*_OUT)


@query("""with c as (select conv_id, turn, sum(coalesce(p, 0)) over (partition by conv_id order by turn rows unbounded preceding) as island from (select conv_id, turn, lag(cast(length(text) % 7 = 0 as int)) over (partition by conv_id order by turn) as p from conversations)),
p as (select *, (row_number() over (partition by conv_id, island order by turn) - 1) // 3 as part from c) select conv_id, row_number() over (partition by conv_id order by min(turn)) - 1 as region, min(turn) as lo, max(turn) as hi from p group by conv_id, island, part""")
def cut_regions(spark, sf_dir):
    return R.cut_regions(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.length("text") % 7 == 0, 3).select("conv_id", "region", "lo", "hi")


@query(f"""with s as (select conv_id, n, n - conv_id % 4 as arrived, conv_id % 3 as succ, conv_id % 5 as nxt, conv_id % 2 as mem from {_STREAMS}), w as (select *, i as index, least((i + 1) * 3, n) + 2 as bhi from s, range(1000) t(i) where i < greatest(ceil(n / 3), 1))
select conv_id, index, arrived >= least(bhi, n) and (bhi - n <= 0 or succ = 0 or nxt >= bhi - n or mem >= bhi - n) as ready from w""")
def readiness(spark, sf_dir):
    w = R.sliding_lookahead(_streams(spark, sf_dir), "n", 3, 2)
    c = F.col("conv_id")
    done = R.ready(F.col("buffer_hi"), F.col("n"), F.col("n") - c % 4, F.lit(False), c % 3, c % 5, c % 2, F.lit(False))
    return w.select("conv_id", "index", done.alias("ready"))


@query("select l_orderkey, max(l_suppkey) + 5 as emitted from lineitem group by all having count(distinct l_linenumber) >= max(l_partkey % 4)")
def fragments_complete(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").withColumn("need", F.col("l_partkey") % 4)
    return R.complete_fragments(line, ["l_orderkey"], "l_linenumber", "need", "l_suppkey", 5)


@query(f"select * from (select user_id, max(case when event_type in ('purchase', 'click') then tick end) - min(case when event_type = 'view' then tick end) as lifetime from {EVENTS} group by all) where lifetime is null or lifetime >= 0")
def hold_lifetime(spark, sf_dir):
    return R.hold_lifetime(events(spark, sf_dir), ["user_id"], "event_type", "tick", "view", ["purchase", "click"])


_LAG = f"(select l_orderkey, l_linenumber, o_custkey, {day_sql('o_orderdate')} as a, {day_sql('l_shipdate')} as b, l_suppkey from lineitem join orders on l_orderkey = o_orderkey)"


@query(f"select o_custkey, count(*) filter (where b > a + 60) as late, count(*) filter (where l_suppkey % 50 >= 45 or b > a + 40) as rescued from {_LAG} group by all")
def late_vs_deadline(spark, sf_dir):
    from trialspan.plans.tables import day

    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", day("o_orderdate").cast("long").alias("a"))
    j = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", day("l_shipdate").cast("long").alias("b")).join(o, "l_orderkey")
    late, rescue = R.late_results(F.col("a"), F.col("b"), 60, 20, F.col("l_suppkey") % 50, 45)
    return j.groupBy("o_custkey").agg(F.count_if(late).alias("late"), F.count_if(rescue.isNotNull()).alias("rescued"))


@query(f"select event_type, count(*) filter (where value < 20) as by_gap, count(*) filter (where event_type <> 'view') as by_status, count(*) as constant from {EVENTS} group by all")
def escalate_verdicts(spark, sf_dir):
    v = R.verdicts(F.col("value"), F.when(F.col("event_type") == "view", "ok").otherwise("bad"), 20.0, F.col("event_id"), 0.25)
    return events(spark, sf_dir).groupBy("event_type").agg(*(F.count_if(v[k]).alias(k) for k in ("by_gap", "by_status", "constant")))


@query("""with c as (select conv_id, turn * 2 as lo, turn * 2 + 1 as hi, length(text) % 6 = 0 as e from conversations), x as (select *, lo - case when e then 3 else 0 end as l, hi + case when e then 3 else 0 end as h from c),
y as (select *, max(h) over w as b, max(case when e then h end) over w as s from x window w as (partition by conv_id order by l, lo rows between unbounded preceding and 1 preceding)), z as (select *, sum(cast(not coalesce(l <= s or (e and l <= b), false) as int)) over (partition by conv_id order by l, lo rows unbounded preceding) as g from y)
select conv_id, min(lo) as lo, max(hi) as hi, bool_or(e) as escalated, count(*) as windows from z group by conv_id, g""")
def absorb_windows(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") * 2).alias("lo"), (F.col("turn") * 2 + 1).alias("hi"), (F.length("text") % 6 == 0).alias("escalated"))
    return R.absorbed(c, ["conv_id"], "lo", "hi", "escalated", 3, {"windows": F.count("*")})


@query("select role, c as checkpoint, count(*) as n, cast(bit_xor(length(text)) as bigint) as folded from conversations, (values (1), (3), (7)) t(c) where turn <= c group by all")
def checkpoints_as_if_ended(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("role", "turn", F.length("text").cast("long").alias("bits"))
    return R.as_if_ended(c, ["role"], "turn", [1, 3, 7], {"n": F.count("*"), "folded": F.bit_xor("bits")})


@query(f"select event_type, t as threshold, count(*) filter (where value < t) as escalated, count(*) filter (where case when value < t then event_id % 50 = 0 else event_id % 7 = 0 end) as failures from {EVENTS}, (values (5.0::double), (20.0), (60.0)) v(t) group by all")
def answer_chains(spark, sf_dir):
    e = events(spark, sf_dir).select("event_type", "event_id", "value", (F.col("event_id") % 7 == 0).alias("weak"), (F.col("event_id") % 50 == 0).alias("strong"))
    return R.answer_chain(e, ["event_type"], "event_id", "weak", "strong", "value", [5.0, 20.0, 60.0])


@query("with i as (select conv_id, turn - row_number() over (partition by conv_id order by turn) as island from conversations where length(text) % 3 <> 0), r as (select conv_id, island, count(*) as n from i group by all) select conv_id, cast(sum(n) as bigint) as idle_rounds, cast(sum(n // 2) as bigint) as jobs from r group by all")
def idle_rounds(spark, sf_dir):
    return R.idle_jobs(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.length("text") % 3 != 0, 2)
