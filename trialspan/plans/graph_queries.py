"""Queries of graphs and simulations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspan.operators import graph as G
from trialspan.operators import simulate as Q
from trialspan.plans.catalogue import query
from trialspan.plans.tables import EVENTS, events, table
from trialspan.sources import scans

_TREE = "(select p_partkey as child, p_partkey // 2 as parent from part where p_partkey > 1)"


def _tree(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 2).alias("parent"))


@query(f"with recursive c as (select child, parent as ancestor, 1 as depth from {_TREE} union all select c.child, t.parent, c.depth + 1 from c join {_TREE} t on t.child = c.ancestor) select child, ancestor, max(depth) as depth from c group by all")
def closure(spark, sf_dir):
    return G.closure(_tree(spark, sf_dir), "child", "parent")


#: Parts in a tree for each of three remainders.
_FOREST = "(select p_partkey as child, p_partkey - 3 * greatest(cast(p_partkey // 6 as bigint), 1) as parent from part where p_partkey > 3)"


@query(f"with recursive e as (select child as a, parent as b from {_FOREST} union select parent, child from {_FOREST}), r as (select a as node, a as c from e union select r.node, e.b from r join e on e.a = r.c) select node, min(c) as component from r group by all")
def components(spark, sf_dir):
    forest = table(spark, sf_dir, "part").where("p_partkey > 3").select(F.col("p_partkey").alias("child"), (F.col("p_partkey") - 3 * F.greatest(F.floor(F.col("p_partkey") / 6), F.lit(1))).alias("parent"))
    return G.components(forest, "child", "parent")


@query(f"with recursive s as (select p_partkey as node, p_size as cost, 0::bigint as start from part where p_partkey <= 1 union all select p.p_partkey, p.p_size, s.start + s.cost from s join {_TREE} t on t.parent = s.node join part p on p.p_partkey = t.child) select node, start, start + cost as end from s")
def release_times(spark, sf_dir):
    return G.release_times(table(spark, sf_dir, "part"), _tree(spark, sf_dir), "p_partkey", "p_size", "child", "parent")


@query("select 'unknown' as problem, p_partkey + 1 as node from part where p_partkey = (select max(p_partkey) from part)")
def graph_problems(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey")
    return G.validated(p, p.select(F.col("p_partkey").alias("child"), (F.col("p_partkey") + 1).alias("parent")), "p_partkey", "child", "parent")


@query(f"with recursive c as (select child, parent as ancestor from {_TREE} union all select c.child, t.parent from c join {_TREE} t on t.child = c.ancestor) select child as window, p_size as item from c join part on p_partkey = ancestor group by all")
def prior_items(spark, sf_dir):
    owned = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("window"), F.col("p_size").alias("item"))
    return G.prior(owned, G.closure(_tree(spark, sf_dir), "child", "parent"), "window", "item").distinct()


@query()
def union_find(spark, sf_dir):
    """Corrections of a ring of 64 nodes, marks from the signs of a whole embedding; the ends of a correction are its marks."""
    edge = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.struct(k.alias("a"), ((k + 1) % 64).alias("b"), (1.0 + k % 3).alias("w")))
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.element_at("embedding", i + 1) > 0).alias("marked"))
    v = v.withColumn("marked", F.when(F.size("marked") % 2 == 0, F.col("marked")).otherwise(F.slice("marked", 2, 63)))
    return G.decoded(v.select("vec_id", F.lit(64).alias("nodes"), edge.alias("edges"), "marked"), "vec_id")


_JOBS = f"(select user_id, event_id, tick, cast(round(value * 1000000) as bigint) as s, row_number() over (partition by user_id order by tick, event_id) as k from {EVENTS})"


def _jobs(spark, sf_dir):
    return events(spark, sf_dir).select("user_id", "event_id", "tick", F.round(F.col("value") * 1000000).cast("long").alias("s"))


@query(f"""with recursive j as {_JOBS}, r as (select user_id, event_id, k, greatest(tick, 0) as start, tick + s as a, 0::bigint as b from j where k = 1
union all select j.user_id, j.event_id, j.k, greatest(j.tick, least(r.a, r.b)), greatest(r.a, r.b), greatest(j.tick, least(r.a, r.b)) + j.s from r join j on j.user_id = r.user_id and j.k = r.k + 1)
select r.event_id, r.start, r.start + j.s as end from r join j using (event_id)""")
def two_server_pool(spark, sf_dir):
    return Q.pool_service(_jobs(spark, sf_dir), ["user_id"], ["tick", "event_id"], "tick", "s", 2).select("event_id", "start", "end")


@query(f"""with recursive j as {_JOBS}, r as (select user_id, event_id, k, tick as start, tick + s as free, tick + s + 50 as landed, 0::bigint as before from j where k = 1
union all select j.user_id, j.event_id, j.k, greatest(j.tick, r.free, case when j.k > 2 then r.before + 70 else 0 end), greatest(j.tick, r.free, case when j.k > 2 then r.before + 70 else 0 end) + j.s, greatest(j.tick, r.free, case when j.k > 2 then r.before + 70 else 0 end) + j.s + 50, r.landed from r join j on j.user_id = r.user_id and j.k = r.k + 1)
select event_id, start, landed from r""")
def credit_channel(spark, sf_dir):
    return Q.credit_channel(_jobs(spark, sf_dir), ["user_id"], ["tick", "event_id"], "tick", "s", 50, 2, 70).select("event_id", "start", "landed")


@query()
def reliable_channel(spark, sf_dir):
    return Q.reliable_channel(_jobs(spark, sf_dir), ["user_id"], ["tick", "event_id"], "tick", "s", 50, 0.05, 7).select("event_id", "landed", "sends")


#: The tree of parts, and from some parts a way down again: to a grandchild's child, or beyond the last part, which closes no cycle.
_LOOPS = f"(select child, parent from {_TREE} union all select p_partkey // 8 as child, p_partkey as parent from part where p_partkey % 101 = 0 union all select p_partkey, 10000000 + p_partkey from part where p_partkey % 7 = 0)"


@query(f"with recursive e as (select distinct child, parent from {_LOOPS}), r as (select child as a, parent as b from e union select r.a, e.parent from r join e on e.child = r.b) select 'cycle' as problem, a as node from r where a = b union all select 'unknown', parent from e where parent >= 10000000")
def graph_cycles(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey")
    id_ = F.col("p_partkey")
    down = p.where(id_ % 101 == 0).select(F.floor(id_ / 8).alias("child"), id_.alias("parent"))
    out = p.where(id_ % 7 == 0).select(id_.alias("child"), (id_ + 10000000).alias("parent"))
    return G.validated(p, _tree(spark, sf_dir).unionByName(down).unionByName(out), "p_partkey", "child", "parent", cycles=True)


#: A model of three nested blocks for each part; c is how often each turns.
_LINES = ["error(0.125) D0 L1", "repeat {a} {{", "  error(0.5) D1 D3", "  repeat {b} {{", "    shift_detectors(0, 1) 2", "    error(0.25) D0 ^ D2", "    repeat {c} {{", "      error(0.0625) D5", "      shift_detectors 1", "    }}", "  }}", "  error(0.75) D1", "  shift_detectors 10", "}}", "error(0.375) D4"]


@query("""with p as (select p_partkey as k, 1 + p_size % 3 as a, p_size % 4 as b, p_size % 5 as c from part where p_size < 12), t as (select *, 10 + b * (2 + c) as s, 2 + b * (1 + c) as e from p),
r as (select k, 0 as ordinal, 0.125 as probability, 0 as d from t union all select k, 1 + i * e, 0.5, i * s + 1 from t, range(9) x(i) where i < a
union all select k, 1 + i * e + 1 + j * (1 + c), 0.25, i * s + j * (2 + c) + 2 from t, range(9) x(i), range(9) y(j) where i < a and j < b
union all select k, 1 + i * e + 1 + j * (1 + c) + 1 + m, 0.0625, i * s + j * (2 + c) + 2 + m + 5 from t, range(9) x(i), range(9) y(j), range(9) z(m) where i < a and j < b and m < c
union all select k, 1 + i * e + 1 + b * (1 + c), 0.75, i * s + b * (2 + c) + 1 from t, range(9) x(i) where i < a union all select k, 1 + a * e, 0.375, a * s + 4 from t)
select k, cast(ordinal as bigint) as ordinal, cast(probability as double) as probability, cast(d as bigint) as first_detector from r""")
def unrolled_models(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_size < 12")
    times = {"a": 1 + F.col("p_size") % 3, "b": F.col("p_size") % 4, "c": F.col("p_size") % 5}
    texts = F.array(*(F.concat_ws("", *(x for part in line.replace("{{", "{").replace("}}", "}").split("|") for x in _filled(part, times))) for line in _LINES))
    lines = p.select(F.col("p_partkey").alias("k"), F.posexplode(texts).alias("no", "line"))
    return scans.unrolled(lines, ["k"], "no", "line").select("k", "ordinal", "probability", F.col("detectors")[0].alias("first_detector"))


def _filled(line, times):
    """The line as pieces, with the column of times for its {name}."""
    for name, column in times.items():
        if f"{{{name}}}" in line:
            before, after = line.split(f"{{{name}}}")
            return [F.lit(before), column.cast("string"), F.lit(after)]
    return [F.lit(line)]
