"""Queries of the aggregates over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspan.functions import scalars as S
from trialspan.operators import aggregates as A
from trialspan.operators import folds
from trialspan.plans.catalogue import query
from trialspan.plans.tables import EVENTS, day, day_sql, events, table

_PCT = "select {k}, {v}, count(*) as c, sum(count(*)) over (partition by {k} order by {v}) as cum, sum(count(*)) over (partition by {k}) as n from {t} group by {k}, {v}"


@query(f"""with m as ({_PCT.format(k='event_type', v='value', t=EVENTS)}), p as (select event_type, min(case when cum > round_even((n - 1) * 0.5, 0) then value end) as p50,
min(case when cum > round_even((n - 1) * 0.9, 0) then value end) as p90, min(case when cum > round_even((n - 1) * 0.99, 0) then value end) as p99 from m group by event_type),
t as (select event_type, count(*) as rows, cast(sum(cast(value as decimal(38,6))) as double) as value_sum, max(value) as value_max, count(distinct user_id) as users from {EVENTS} group by event_type)
select t.*, p50, p90, p99 from t join p using (event_type)""")
def event_summary(spark, sf_dir):
    e = events(spark, sf_dir)
    totals = e.groupBy("event_type").agg(F.count("*").alias("rows"), F.sum(F.col("value").cast("decimal(38,6)")).cast("double").alias("value_sum"), F.max("value").alias("value_max"), F.count_distinct("user_id").alias("users"))
    return totals.join(A.nearest_percentile(A.value_counts(e, ["event_type"], "value"), ["event_type"], "value", {"p50": 0.5, "p90": 0.9, "p99": 0.99}), "event_type")


@query(f"select event_type, value, count(*) as count from {EVENTS} group by all")
def multiset_counts(spark, sf_dir):
    return A.value_counts(events(spark, sf_dir), ["event_type"], "value")


@query("select l_returnflag, l_quantity, count(*) as count from lineitem group by all")
def multiset_merge(spark, sf_dir):
    pieces = A.value_counts(table(spark, sf_dir, "lineitem").withColumn("piece", F.col("l_orderkey") % 7), ["l_returnflag", "piece"], "l_quantity")
    return A.merged_counts(pieces, ["l_returnflag"], "l_quantity")


@query(f"""with m as ({_PCT.format(k='l_shipmode_key', v='l_quantity', t='(select l_returnflag as l_shipmode_key, l_quantity from lineitem)')})
select l_shipmode_key as l_returnflag, min(case when cum > round_even((n - 1) * 0.5, 0) then l_quantity end) as p50, min(case when cum > round_even((n - 1) * 0.9, 0) then l_quantity end) as p90 from m group by 1""")
def nearest_percentile(spark, sf_dir):
    return A.nearest_percentile(A.value_counts(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity"), ["l_returnflag"], "l_quantity", {"p50": 0.5, "p90": 0.9})


@query(f"""with m as ({_PCT.format(k='l_linestatus', v='l_quantity', t='lineitem')}) select l_linestatus, min(case when cum >= n * 0.25 then l_quantity end) as q25, min(case when cum >= n * 0.75 then l_quantity end) as q75 from m group by 1""")
def reach_quantile(spark, sf_dir):
    return A.reach_quantile(A.value_counts(table(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_quantity"), ["l_linestatus"], "l_quantity", {"q25": 0.25, "q75": 0.75})


@query("""select o_orderpriority, count(*) as rows, round(avg(o_totalprice), 4) as price_mean, max(o_totalprice) as price_max, cast(sum(cast(o_totalprice as decimal(38,4))) as double) as price_sum,
count(*) filter (where o_orderstatus = 'F') as done_count from orders group by all""")
def role_totals(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_totalprice").alias("price"), F.col("o_totalprice").cast("decimal(38,4)").alias("exact"), (F.col("o_orderstatus") == "F").alias("done"))
    out = A.role_totals(o, ["o_orderpriority"], means=["price"], maxes=["price"], sums=["exact"], true_counts=["done"])
    return out.withColumn("price_mean", F.round("price_mean", 4)).withColumn("price_sum", F.col("exact_sum").cast("double")).drop("exact_sum")


@query(f"select event_type, cast(sum(cast(value as decimal(38,18))) as double) as exact_sum from {EVENTS} group by all")
def exact_sum(spark, sf_dir):
    return A.exact_sum(events(spark, sf_dir), ["event_type"], "value")


@query(f"select event_type, cast(sum(cast(value as decimal(38,18))) as double) as exact_sum from {EVENTS} group by all")
def exact_float_sum(spark, sf_dir):
    return A.exact_float_sum(events(spark, sf_dir), ["event_type"], "value")


@query("select l_linestatus, sum(cast(l_quantity as bigint)) / sum(cast(l_linenumber as bigint)) as ratio from lineitem group by all")
def ratio_of_sums(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(A.ratio(F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")).alias("ratio"))


@query("with m as (select l_returnflag, cast(l_quantity as bigint) as v, count(*) as c from lineitem group by all) select l_returnflag, sum(v * c) / sum(c) as mean from m group by all")
def weighted_mean(spark, sf_dir):
    counts = A.value_counts(table(spark, sf_dir, "lineitem").withColumn("v", F.col("l_quantity").cast("long")), ["l_returnflag"], "v")
    return counts.groupBy("l_returnflag").agg(A.weighted_mean(F.col("v"), F.col("count")).alias("mean"))


@query("select l_returnflag, l_linestatus, count(*) as n, cast(sum(cast(l_quantity as bigint)) as bigint) as quantity from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag))")
def tier_rollup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupingSets([["l_returnflag", "l_linestatus"], ["l_returnflag"]], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


@query("select l_returnflag, l_linestatus, count(*) as n, cast(sum(cast(l_quantity as bigint)) as bigint) as quantity, grouping(l_returnflag, l_linestatus) as level from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())")
def tallies_grouping_sets(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupingSets([["l_returnflag"], ["l_linestatus"], []], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.grouping_id().alias("level"))


@query("select l_linenumber as path, count(*) as transfers, cast(sum(cast(l_quantity as bigint)) as bigint) as payload, count(*) filter (where l_discount = 0) as unknown from lineitem group by all")
def counters_by_path(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("path")).agg(F.count("*").alias("transfers"), F.sum(F.col("l_quantity").cast("long")).alias("payload"), F.count_if(F.col("l_discount") == 0).alias("unknown"))


@query("with piece as (select l_returnflag, l_orderkey // 1000 as piece, min(l_orderkey) as first_seed, count(*) as shots, cast(sum(cast(l_quantity as bigint)) as bigint) as total from lineitem group by all) select l_returnflag, count(*) as pieces, min(first_seed) as first_seed, cast(sum(shots) as bigint) as shots, cast(sum(total) as bigint) as total from piece group by all")
def partial_final(spark, sf_dir):
    pieces = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.floor(F.col("l_orderkey") / 1000).alias("piece")).agg(F.min("l_orderkey").alias("first_seed"), F.count("*").alias("shots"), F.sum(F.col("l_quantity").cast("long")).alias("total"))
    return pieces.groupBy("l_returnflag").agg(F.count("*").alias("pieces"), F.min("first_seed").alias("first_seed"), F.sum("shots").alias("shots"), F.sum("total").alias("total"))


_FIELDS = f"(select user_id, case event_id % 4 when 0 then 'peak' when 1 then 'minimum' when 2 then 'count' else 'maximum' end as field, event_id % 1000 as v from {EVENTS})"


@query(f"select user_id, field, cast(case when field in ('peak', 'maximum') then max(v) when field = 'minimum' then min(v) else sum(v) end as bigint) as v from {_FIELDS} group by user_id, field")
def field_fold_law(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", F.element_at(F.array(*map(F.lit, ("peak", "minimum", "count", "maximum"))), (F.col("event_id") % 4 + 1).cast("int")).alias("field"), (F.col("event_id") % 1000).alias("v"))
    return e.groupBy("user_id", "field").agg(A.field_fold(F.col("field"), F.col("v")).alias("v"))


@query(f"with w as (select event_type, count(*) as n, max(event_id) as peak, cast(sum(event_id) as bigint) as total from {EVENTS} group by all) select event_type, field, v from w unpivot (v for field in (n, peak, total))")
def stat_summary(spark, sf_dir):
    w = events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("peak"), F.sum("event_id").alias("total"))
    return w.unpivot("event_type", ["n", "peak", "total"], "field", "v")


@query(f"select event_type, floor(value * 10) / 10 as gap_low, count(*) as count from {EVENTS} group by all")
def db_histogram(spark, sf_dir):
    return A.gap_histogram(events(spark, sf_dir), ["event_type"], F.floor(F.col("value") * 10) / 10.0)


_EDGES = [0.0, 10.0, 25.0, 50.0, 100.0, float("inf")]


@query(f"""select bin, count(*) as windows, count(*) filter (where event_type = 'purchase') as escalated, count(*) filter (where event_type = 'click') as weak from
(select *, case when value >= 0 and value < 10 then 0 when value >= 10 and value < 25 then 1 when value >= 25 and value < 50 then 2 when value >= 50 and value < 100 then 3 when value >= 100 then 4 end as bin from {EVENTS}) group by bin""")
def edge_bins(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("bin", S.edge_bin(F.col("value"), _EDGES))
    return e.groupBy("bin").agg(F.count("*").alias("windows"), F.count_if(F.col("event_type") == "purchase").alias("escalated"), F.count_if(F.col("event_type") == "click").alias("weak"))


@query("select cast(floor(n_chars / 500) as bigint) as bin, count(*) as n, count(*) filter (where lang <> 'en') as hits from documents group by all having count(*) filter (where lang <> 'en') > 0")
def failure_by_bin(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.floor(F.col("n_chars") / 500).alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col("lang") != "en").alias("hits")).where("hits > 0")


@query(f"select user_id, case when count(*) = count(g) then min(g) end as least from (select user_id, case when event_id % 37 = 0 then null else value end as g from {EVENTS}) group by all")
def null_dominant_min(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("g", F.when(F.col("event_id") % 37 != 0, F.col("value")))
    return e.groupBy("user_id").agg(A.strict_minimum(F.col("g")).alias("least"))


@query("select o_orderpriority, n, hits, round(hits / n, 9) as rate, round(sqrt((hits / n) * (1 - hits / n) / n), 9) as error from (select o_orderpriority, count(*) as n, count(*) filter (where o_orderstatus = 'F') as hits from orders group by all)")
def binomial_rate_se(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("hits"))
    rate, error = A.binomial(F.col("hits"), F.col("n"))
    return g.select("o_orderpriority", "n", "hits", F.round(rate, 9).alias("rate"), F.round(error, 9).alias("error"))


@query("select l_returnflag, median(l_quantity) as middle, min(l_quantity) as low, max(l_quantity) as high from lineitem group by all")
def median_range(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.percentile("l_quantity", F.lit(0.5)).alias("middle"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))


@query("select role, count(distinct (conv_id, turn)) as rounds from conversations group by all")
def distinct_pairs(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count_distinct(F.struct("conv_id", "turn")).alias("rounds"))


@query("select conv_id, case when count(distinct role) = 1 then max(role) else 'several' end as role from conversations group by all")
def single_or_zero(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(A.single_or(F.col("role"), F.lit("several")).alias("role"))


@query(f"select user_id, string_agg(distinct event_type, ';' order by event_type) as kinds from {EVENTS} group by all")
def distinct_join(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id").agg(A.distinct_join(F.col("event_type")).alias("kinds"))


@query("select lang, bool_or(n_chars > 5000) as any_long from documents group by all")
def any_wrong(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.bool_or(F.col("n_chars") > 5000).alias("any_long"))


_WORD = "list_sum(list_transform(range(1, 33), lambda i: case when embedding[i + {0}] > 0 then cast(pow(2, i - 1) as bigint) else 0 end))::bigint"


@query(f"select label, bit_xor(low) as low, bit_xor(high) as high from (select label, {_WORD.format(0)} as low, {_WORD.format(32)} as high from embeddings) group by all")
def xor_fold(spark, sf_dir):
    """The signs of all 64 components, as two words."""
    v = table(spark, sf_dir, "embeddings").select("label", _sign_bits(0).alias("low"), _sign_bits(32).alias("high"))
    return v.groupBy("label").agg(A.xor_fold(F.col("low")).alias("low"), A.xor_fold(F.col("high")).alias("high"))


def _sign_bits(first: int) -> F.Column:
    """The signs of 32 components as the bits of a long."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda a, i: a + F.when(F.element_at("embedding", i + first + 1) > 0, F.expr("1L")).otherwise(F.expr("0L")) * F.pow(F.lit(2.0), i).cast("long"))


@query("select l_suppkey % 10 as k, l_linenumber as row, count(*) % 2 as parity from lineitem join (select distinct p_partkey from part where p_size % 2 = 1) on l_partkey = p_partkey group by all")
def parity_product(spark, sf_dir):
    matrix = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("row"), F.col("l_partkey").alias("col"), (F.col("l_suppkey") % 10).alias("k"))
    vector = table(spark, sf_dir, "part").where("p_size % 2 = 1").select(F.col("p_partkey").alias("col")).distinct()
    return A.parity_product(matrix, vector, "row", "col", "k")


@query("select l_suppkey, l_partkey % 50 as id from lineitem group by all having count(*) % 2 = 1")
def odd_ids(spark, sf_dir):
    return A.odd_ids(table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_partkey") % 50), ["l_suppkey"], "id")


@query("""with recipe as (select d, (d * 7 + k * 3) % 64 as bit from range(16) a(d), range(3) b(k)), bits as (select vec_id, i as bit, cast(embedding[i + 1] > 0 as int) as v from embeddings, range(64) r(i))
select vec_id, cast(d as bigint) as detector, bit_xor(v) as value from bits join recipe using (bit) group by all""")
def formation(spark, sf_dir):
    recipe = spark.range(16).select(F.col("id").alias("detector"), F.explode(F.array(*((F.col("id") * 7 + 3 * k) % 64 for k in range(3)))).alias("bit"))
    bits = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding")).select("vec_id", F.col("pos").cast("long").alias("bit"), (F.col("col") > 0).cast("int").alias("v"))
    return bits.join(recipe, "bit").groupBy("vec_id", "detector").agg(F.bit_xor("v").alias("value"))


@query(f"select user_id, round((1 - product(1 - 2 * p)) / 2, 9) as p from (select user_id, (event_id % 20) / 1000.0 as p from {EVENTS}) group by all")
def probability_merge(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("p", (F.col("event_id") % 20) / 1000.0)
    return e.groupBy("user_id").agg(F.round(A.merged_probability(F.col("p")), 9).alias("p"))


@query("select conv_id, sha256(string_agg(text, '|' order by turn)) as digest from conversations group by all")
def ordered_digest(spark, sf_dir):
    return folds.ordered_digest(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "text")


@query(f"select event_type, case when max(tick) > min(tick) then count(*) / ((max(tick) - min(tick)) / 1e6) else 0 end as per_second from {EVENTS} group by all")
def throughput(spark, sf_dir):
    span = F.max("tick") - F.min("tick")
    return events(spark, sf_dir).groupBy("event_type").agg(F.when(span > 0, F.count("*") / (span / 1e6)).otherwise(0.0).alias("per_second"))


@query(f"select event_type, sum(cast(round(value * 1000) as bigint)) / (2.0 * (max(tick) - min(tick))) as load, ceil(2.0 * sum(cast(round(value * 1000) as bigint)) / (max(tick) - min(tick))) as need from {EVENTS} group by all")
def offered_load(spark, sf_dir):
    busy, span = F.sum(F.round(F.col("value") * 1000).cast("long")), F.max("tick") - F.min("tick")
    return events(spark, sf_dir).groupBy("event_type").agg((busy / (2.0 * span)).alias("load"), F.ceil(2.0 * busy / span).cast("double").alias("need"))


@query(f"select user_id, case when count(distinct x) > 1 then round(regr_slope(y, x), 6) end as slope from (select user_id, event_id % 977 as y, event_id % 101 as x from {EVENTS}) group by all")
def growth_slope(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", (F.col("event_id") % 977).alias("y"), (F.col("event_id") % 101).alias("x"))
    return e.groupBy("user_id").agg(F.round(A.slope(F.col("y"), F.col("x")), 6).alias("slope"))


@query(f"select user_id, round((count(*)::double * sum(x::hugeint * y)::double - sum(x)::double * sum(y)::double) / nullif(count(*)::double * sum(x::hugeint * x)::double - sum(x)::double * sum(x)::double, 0), 6) as slope from (select user_id, event_id % 977 as y, event_id % 101 as x from {EVENTS}) group by all")
def growth_slope_exact(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", (F.col("event_id") % 977).alias("y"), (F.col("event_id") % 101).alias("x"))
    return e.groupBy("user_id").agg(F.round(A.exact_slope("y", "x"), 6).alias("slope"))


_LATE = f"(select l_returnflag, l_orderkey, l_linenumber, {day_sql('l_shipdate')} - {day_sql('o_orderdate')} as gap from lineitem join orders on l_orderkey = o_orderkey)"


@query(f"select l_returnflag, count(*) filter (where gap > 60) as misses, min(l_orderkey * 10 + l_linenumber) filter (where gap > 60) as first_miss from {_LATE} group by all")
def deadline_misses(spark, sf_dir):
    j = _late(spark, sf_dir)
    return j.groupBy("l_returnflag").agg(F.count_if(F.col("gap") > 60).alias("misses"), F.min(F.when(F.col("gap") > 60, F.col("l_orderkey") * 10 + F.col("l_linenumber"))).alias("first_miss"))


def _late(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), day("o_orderdate").alias("o_day"))
    line = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", day("l_shipdate").alias("s_day"))
    return line.join(o, "l_orderkey").withColumn("gap", F.col("s_day") - F.col("o_day"))


@query(f"select l_orderkey, cast(max({day_sql('l_shipdate')}) - min({day_sql('l_shipdate')}) as bigint) as span, cast(sum(cast(l_quantity as bigint)) as bigint) as delay, max(l_linenumber) as landed, min({day_sql('l_shipdate')}) filter (where l_returnflag <> 'R') as first_send from lineitem group by all")
def link_span(spark, sf_dir):
    d = day("l_shipdate")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.max(d) - F.min(d)).alias("span"), F.sum(F.col("l_quantity").cast("long")).alias("delay"), F.max("l_linenumber").alias("landed"), F.min(F.when(F.col("l_returnflag") != "R", d)).alias("first_send"))


@query("select vec_id, list_sum(list_transform(embedding, lambda x: cast(x > 0 as int)))::bigint as weight from embeddings")
def bit_weight(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.bit_count(_sign_bits(0)) + F.bit_count(_sign_bits(32))).cast("long").alias("weight"))


@query("""with v as (select l_orderkey, l_returnflag, count(*) as votes, min(l_linenumber) as first from lineitem group by all)
select l_orderkey, l_returnflag, votes / sum_votes as share from (select *, sum(votes) over (partition by l_orderkey) as sum_votes, row_number() over (partition by l_orderkey order by votes desc, first, l_returnflag) as r from v) where r = 1""")
def majority_vote(spark, sf_dir):
    return A.majority(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag", "l_linenumber")


@query("""with m as (select l_orderkey, l_returnflag, sum(exp(-l_quantity)) as mass from lineitem group by all) select l_orderkey, arg_max(l_returnflag, (mass, l_returnflag)) as l_returnflag from m group by all""")
def pooled(spark, sf_dir):
    return A.sum_likelihood(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag", "l_quantity")
