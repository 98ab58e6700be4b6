"""Queries that write the driver's tables in the engine's own formats and read them back."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from trialspan.functions import scalars as S
from trialspan.operators import aggregates as A
from trialspan.operators import measures
from trialspan.operators import windows as R
from trialspan.plans import fold, sweep
from trialspan.plans.catalogue import query
from trialspan.plans.tables import EVENTS, events, table
from trialspan.session import fresh_path
from trialspan.sources import files, scans, sinks

_SHOTS = f"(select event_type as task_id, 'uf' as algorithm, row_number() over (partition by event_type order by event_id) - 1 as seed, event_id % 5 = 0 as failed, event_id % 11 <> 0 as scored, value as reaction_us, user_id as windows from {EVENTS})"
_TYPES = {"seed": "long", "failed": "boolean", "scored": "boolean", "reaction_us": "double", "windows": "long"}


def _shots(spark, sf_dir):
    from pyspark.sql import Window

    seed = (F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")) - 1).cast("long")
    e = events(spark, sf_dir)
    return e.select(F.col("event_type").alias("task_id"), F.lit("uf").alias("algorithm"), seed.alias("seed"), (F.col("event_id") % 5 == 0).alias("failed"), (F.col("event_id") % 11 != 0).alias("scored"), F.col("value").alias("reaction_us"), F.col("user_id").alias("windows"))


def _pieces(spark, sf_dir, tasks=("click", "purchase"), cut=40):
    """Two pieces of each task: its first seeds, and the rest."""
    where, shots = fresh_path(spark, "experiment"), _shots(spark, sf_dir)
    sizes = {r["task_id"]: r["count"] for r in shots.groupBy("task_id").count().collect()}
    for task in tasks:
        one = shots.where(F.col("task_id") == task)
        for first, n in ((0, cut), (cut, sizes[task] - cut)):
            fold.record(spark, where, one.where((F.col("seed") >= first) & (F.col("seed") < first + n)), task, first, n)
    return where


@query(f"select task_id, count(*) as shots, cast(sum(seed) as bigint) as seeds, count(*) filter (where failed) as failures, round(sum(reaction_us), 6) as reaction, cast(sum(windows) as bigint) as windows, count(distinct case when seed < 40 then 0 else 40 end) as pieces from {_SHOTS} where task_id in ('click', 'purchase') group by all")
def io_pieces(spark, sf_dir):
    """CSV pieces, whole by one rename each, found and read again by one scan of their headers and one of their rows."""
    rows = scans.typed(scans.piece_rows(spark, scans.piece_folders(spark, _pieces(spark, sf_dir)), "shots.csv"), _TYPES | {"first_seed": "long"})
    return rows.groupBy("task_id").agg(F.count("*").alias("shots"), F.sum("seed").alias("seeds"), F.count_if("failed").alias("failures"), F.round(F.sum("reaction_us"), 6).alias("reaction"), F.sum("windows").alias("windows"), F.count_distinct("first_seed").alias("pieces"))


@query(f"with n as (select task_id, count(*) as n from {_SHOTS} where task_id in ('click', 'purchase') group by all) select task_id, 0::bigint as first_seed, 40::bigint as seeds from n union all select task_id, 40, n - 40 from n")
def io_piece_facts(spark, sf_dir):
    return scans.piece_facts(spark, _pieces(spark, sf_dir)).select("task_id", "first_seed", "seeds")


@query(f"select task_id, count(*) as shots, count(*) filter (where failed and scored) as failures, count(*) filter (where scored) as scored from {_SHOTS} where task_id in ('click', 'purchase') group by all")
def io_fold(spark, sf_dir):
    """Pieces folded and published, the sweep after all else, and read from where it was published."""
    where = _pieces(spark, sf_dir)
    fold.fold(spark, where, f"{where}-fold", _TYPES, target=10**9)
    told = files.read_json(spark, f"{where}-fold/run.json")
    shots = spark.read.parquet(f"{where}-fold/shots").where(F.col("task_id").isin(told["tasks"]))
    sweep_ = spark.read.parquet(f"{where}-fold/sweep").select("task_id", F.col("prefix_failures").cast("long").alias("failures"), F.col("prefix_scored").cast("long").alias("scored"))
    return shots.groupBy("task_id").agg(F.count("*").alias("shots")).join(sweep_, "task_id")


@query(f"select 'lane ' || (user_id % 4) as lane, event_type as name, count(*) as n, round(sum(value), 6) as dur, cast(max(event_id) as bigint) as last from {EVENTS} group by all")
def io_trace(spark, sf_dir):
    """Events as a trace whose threads are named by metadata rows."""
    tid = F.col("user_id") % 4
    e = events(spark, sf_dir).select(F.col("event_type").alias("name"), F.lit("event").alias("cat"), F.lit("X").alias("ph"), F.col("tick").cast("double").alias("ts"), F.col("value").alias("dur"), F.lit(1).cast("long").alias("pid"), tid.alias("tid"), F.create_map(F.lit("id"), F.col("event_id").cast("string")).alias("args"), F.concat(F.lit("lane "), tid.cast("string")).alias("lane"))
    path = fresh_path(spark, "trace")
    sinks.write_trace(e, path)
    t = scans.trace(spark, path)
    return t.groupBy("lane", "name").agg(F.count("*").alias("n"), F.round(F.sum("dur"), 6).alias("dur"), F.max(F.col("args")["id"].cast("long")).alias("last"))


@query("select lane, name, n from (select 'lane ' || (user_id % 4) as lane, event_type as name, count(*) as n, row_number() over (partition by user_id % 4 order by count(*) desc, event_type) as r from events group by user_id % 4, event_type) where r = 1")
def io_trace_counts(spark, sf_dir):
    """Of each named thread the kind of event that is most frequent, counted on the trace."""
    t = _trace_of(spark, sf_dir)
    counts = t.groupBy("lane", "name").agg(F.count("*").alias("n"))
    best = F.min_by(F.struct("name", "n"), F.struct(-F.col("n"), F.col("name")))
    return counts.groupBy("lane").agg(best.alias("x")).select("lane", "x.*")


def _trace_of(spark, sf_dir):
    path, tid = fresh_path(spark, "trace"), F.col("user_id") % 4
    e = events(spark, sf_dir).select(F.col("event_type").alias("name"), F.lit("X").alias("ph"), F.col("tick").cast("double").alias("ts"), F.lit(1).cast("long").alias("pid"), tid.alias("tid"), F.concat(F.lit("lane "), tid.cast("string")).alias("lane"), F.lit(None).cast("string").alias("cat"), F.lit(None).cast("double").alias("dur"), F.lit(None).cast("map<string,string>").alias("args"))
    sinks.write_trace(e, path)
    return scans.trace(spark, path)


@query("select vec_id // 100 as part, count(*) as n, cast(sum(vec_id) as bigint) as ids, 0::bigint as damaged from embeddings group by all")
def io_dataset(spark, sf_dir):
    """Vectors as a sealed dataset: chunks of a hundred, each file with its hash in the manifest, none damaged."""
    path = fresh_path(spark, "dataset")
    sinks.write_dataset(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "root_seed"), path, 100)
    bad = scans.damaged(spark, path).agg(F.count("*").alias("damaged"))
    shots = scans.shot_dataset(spark, path).groupBy(F.floor(F.col("root_seed") / 100).alias("part")).agg(F.count("*").alias("n"), F.sum("root_seed").alias("ids"))
    return shots.join(F.broadcast(bad))


@query(f"select event_type as task_id, count(*) as links, cast(sum(event_id) as bigint) as ids from {EVENTS} group by all having event_type in ('click', 'view')")
def io_record_tables(spark, sf_dir):
    """Additive tables in a folder each, a partition for each task, of which two are read."""
    where = fresh_path(spark, "record")
    e = events(spark, sf_dir).select(F.col("event_type").alias("task_id"), F.lit("uf").alias("algorithm"), F.col("event_id").alias("seed"), "event_id", F.col("user_id").alias("link"))
    sinks.write_record({"shots": e.drop("link"), "shot_links": e}, where)
    links = spark.read.parquet(f"{where}/shot_links").where("task_id in ('click', 'view')")
    return links.groupBy("task_id").agg(F.count("*").alias("links"), F.sum("event_id").alias("ids"))


@query(f"select user_id, n as window_count, threshold, event from (select user_id, n, threshold, 'step' as event from (select user_id, event_id as n, value as threshold from {EVENTS} where user_id = 1) union all select user_id, event_id, value, 'end' from {EVENTS} where event_id = (select max(event_id) from events where user_id = 1))")
def io_trajectory(spark, sf_dir):
    """The values of one user as a threshold trajectory with its end row, typed by trial when it is read."""
    e = events(spark, sf_dir).where("user_id = 1").select(F.col("event_id").alias("window_count"), F.col("value").alias("threshold_db"), F.lit("step").alias("event"))
    path = fresh_path(spark, "trajectory")
    sinks.write_trajectory(e, path)
    back = scans.typed_by_trial(scans.text_rows(spark, path))
    return back.select(F.lit(1).cast("long").alias("user_id"), "window_count", F.col("threshold_db").alias("threshold"), "event")


@query("select p_partkey as id, 'op' || (p_size % 3) as kind, p_size * 2 as duration, case when p_partkey > 1 then [p_partkey // 2] else []::bigint[] end as before, [[p_size, p_partkey % 7]] as cells from part where p_partkey < 200")
def io_schedule(spark, sf_dir):
    """Parts as the instructions of a schedule text, one a line."""
    p = table(spark, sf_dir, "part").where("p_partkey < 200")
    before = F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 2).cast("string")).otherwise(F.lit(""))
    line = F.format_string("op%d f%d [(%d, %d)] %d [%s]", F.col("p_size") % 3, F.col("p_partkey"), "p_size", F.col("p_partkey") % 7, F.col("p_size") * 2, before)
    path = fresh_path(spark, "schedule")
    sinks.write_lines(p.coalesce(1), path, ["p_partkey"], line)
    back = scans.schedule(spark, path)
    return back.select(F.regexp_extract("flag", r"f(\d+)", 1).cast("long").alias("id"), "kind", "duration", "before", "cells")


@query("select p_partkey as task_id, p_size as size, p_partkey % 2 = 0 as even from part where p_partkey < 40")
def io_task_records(spark, sf_dir):
    """A JSON document for each task in the task's folder."""
    where = fresh_path(spark, "records")
    p = table(spark, sf_dir, "part").where("p_partkey < 40").select(F.col("p_partkey").alias("task"), F.col("p_size").alias("size"), (F.col("p_partkey") % 2 == 0).alias("even"))
    p.withColumn("folder", F.col("task")).repartition("folder").write.partitionBy("folder").json(where)
    return scans.task_records(spark, f"{where}/folder=*/*.json").select(F.regexp_extract("task_id", r"(\d+)", 1).cast("long").alias("task_id"), "size", "even")


@query("select l_orderkey, count(*) as operations, cast(sum(l_partkey) as bigint) as parts from lineitem where l_orderkey < 300 group by all")
def io_workload(spark, sf_dir):
    path = fresh_path(spark, "workload")
    sinks.write_workload(table(spark, sf_dir, "lineitem").where("l_orderkey < 300").select("l_orderkey", "l_linenumber", "l_partkey"), path)
    return scans.workload(spark, path).groupBy("l_orderkey").agg(F.count("*").alias("operations"), F.sum("l_partkey").alias("parts"))


@query("select event_type, 't' || 'uple:2:' || length(a) || ':' || a || length(b) || ':' || b as identity, a as first, b as second from (select event_type, 'str:' || length(event_type) || ':' || event_type as a, 'int:' || length(count(*)::varchar) || ':' || count(*) as b from events group by event_type)")
def nested_identities(spark, sf_dir):
    """Identities of two parts, encoded and taken apart again."""
    g = events(spark, sf_dir).groupBy("event_type").agg(F.count("*").cast("string").alias("n"))
    whole = S.nested_identity(S.identity_bytes(F.lit("str"), F.col("event_type")), S.identity_bytes(F.lit("int"), F.col("n")))
    parts = S.identity_parts(F.col("identity"))
    return g.select("event_type", whole.alias("identity")).select("event_type", "identity", parts[0].alias("first"), parts[1].alias("second"))


_POINT_SQL = "list_sort(list(us) filter (where {w}))[(round_even((count(*) filter (where {w}) - 1) * {f}, 0))::bigint + 1]"


@query(f"""with s as (select event_type as task_id, event_id % 2 as algorithm, event_id % 7 + 1 as decoded, event_id % 3 as up, event_id % 5 = 0 as lf, event_id % 11 <> 0 as sc, value as v, user_id as q, event_id from {EVENTS}),
c as (select event_type as task_id, event_id % 2 as algorithm, case when event_id % 3 = 0 then 'strong' else 'weak' end as tier, cast(floor(value) as bigint) as us from {EVENTS}),
t as (select task_id, algorithm, count(*) as shots, count(*) filter (where lf) as logical_failures, count(*) filter (where sc) as scored_shots, count(*) filter (where not sc) as unscored_shots, (count(*) filter (where lf) + count(*) filter (where not sc)) / count(*) as logical_error_rate_unscored_as_failures,
 avg(decoded) as windows_per_shot, avg(v) as load, max(q) as backlog_peak_rounds, max(q) as strong_wait_max_us, cast(sum(up) as bigint) as escalated_windows, cast(sum(decoded) as bigint) as executed_rounds, cast(sum(event_id % 4) as bigint) as deadline_missed_windows, sum(v) / nullif(sum(up), 0) as strong_service_mean_us, max(q) / 3.0 * sum(decoded) / nullif(sum(up), 0) as strong_service_bound_us, sum(up) / sum(decoded) as escalated_fraction, avg(v) as buffer0_ready_to_frame_mean_us, max(v) as buffer0_ready_to_frame_max_us from s group by all),
p as (select task_id, algorithm, {_POINT_SQL.format(w="true", f="0.5")} as buffer0_ready_to_frame_median_us, {_POINT_SQL.format(w="true", f="0.99")} as buffer0_ready_to_frame_p99_us, {_POINT_SQL.format(w="tier = 'weak'", f="0.5")} as buffer0_ready_to_frame_weak_median_us, {_POINT_SQL.format(w="tier = 'weak'", f="0.99")} as buffer0_ready_to_frame_weak_p99_us,
 {_POINT_SQL.format(w="tier = 'strong'", f="0.5")} as buffer0_ready_to_frame_strong_median_us, {_POINT_SQL.format(w="tier = 'strong'", f="0.99")} as buffer0_ready_to_frame_strong_p99_us, count(*) as n from c group by all)
select t.*, p.* exclude (task_id, algorithm, n), deadline_missed_windows / n as deadline_missed_fraction from t join p using (task_id, algorithm)""")
def sweep_row(spark, sf_dir):
    """The wide row of each task: a shot for each event, a window sample for each event."""
    e, k = events(spark, sf_dir), F.col("event_id")
    key = [F.col("event_type").alias("task_id"), (k % 2).alias("algorithm")]
    shots = e.select(*key, k.alias("seed"), (k % 7 + 1).alias("decoded_windows"), (k % 7 + 1).alias("executed_rounds"), (k % 3).alias("escalated_windows"), (k % 4).alias("deadline_missed_windows"), (k % 5 == 0).alias("logical_failure"), (k % 11 != 0).alias("is_scored"), F.col("value").alias("load"), F.col("user_id").alias("backlog_peak_rounds"), F.col("user_id").alias("strong_wait_max_us"), F.col("user_id").alias("window_period_us"), F.lit(3).alias("commit_rounds"), F.col("value").alias("strong_service_sum_us"), F.col("value").alias("buffer0_ready_to_frame_mean_us"), F.col("value").alias("buffer0_ready_to_frame_max_us"))
    samples = e.select(*key, F.lit(sweep.SPLIT_POINT).alias("point"), F.when(k % 3 == 0, "strong").otherwise("weak").alias("tier"), F.floor("value").alias("value_us"))
    return sweep.rows(shots, samples.groupBy("task_id", "algorithm", "point", "tier", "value_us").agg(F.count("*").alias("count")))


@query(f"select event_type as task_id, cast(floor(value) as bigint) as value_us, count(*) as count from {EVENTS} group by all")
def io_records_together(spark, sf_dir):
    """Value counts of two records, one of even and one of odd events, read as those of one."""
    folders = []
    for half in (0, 1):
        e = events(spark, sf_dir).where(F.col("event_id") % 2 == half)
        counts = e.groupBy(F.col("event_type").alias("task_id"), F.lit("uf").alias("algorithm"), F.lit("service").alias("point"), F.lit("weak").alias("tier"), F.floor("value").alias("value_us")).agg(F.count("*").alias("count"))
        folders.append(fresh_path(spark, "record"))
        sinks.write_record({"latency_samples": counts}, folders[-1])
    return scans.read_record(spark, folders, "latency_samples").select("task_id", "value_us", "count")


@query("select event_type, count(*) as n from events group by all")
def io_state(spark, sf_dir):
    """Counts by type as a saved state, read only if it has the hash that was recorded."""
    counts = {r["event_type"]: r["count"] for r in table(spark, sf_dir, "events").groupBy("event_type").count().collect()}
    text, path = json.dumps(counts, sort_keys=True), fresh_path(spark, "state")
    files.write_text(spark, text, path)
    state = json.loads(scans.checked_state(spark, path, hashlib.sha256(text.encode()).hexdigest()))
    return spark.createDataFrame(sorted(state.items()), "event_type string, n long")


@query("select ph, cat, count(*) as events, count(distinct user_id) as requests, arg_max(event_type, (value, -rn)) as longest from (select 'X' as ph, 'c' || (event_id % 3) as cat, *, row_number() over (order by ts, event_id) as rn from events) group by all")
def io_trace_paths(spark, sf_dir):
    """Of a trace by category its events, distinct requests and the longest event, the first on ties."""
    e = events(spark, sf_dir)
    rows = e.select(F.col("event_type").alias("name"), F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string")).alias("cat"), F.lit("X").alias("ph"), F.col("tick").cast("double").alias("ts"), F.col("value").alias("dur"), F.lit(1).cast("long").alias("pid"), F.col("event_id").alias("tid"), F.create_map(F.lit("request"), F.col("user_id").cast("string")).alias("args"))
    path = fresh_path(spark, "trace")
    sinks.write_trace(rows, path)
    return measures.path_counts(scans.trace(spark, path))


@query(f"with t as (select event_type, round(avg(value), 6) as threshold from {EVENTS} where event_type <> 'view' group by all) select event_id, threshold from {EVENTS} left join t using (event_type)")
def threshold_lookup(spark, sf_dir):
    e = events(spark, sf_dir)
    thresholds = e.where("event_type <> 'view'").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("threshold"))
    return scans.threshold_for(e.select("event_id", "event_type"), thresholds, ["event_type"], "threshold").select("event_id", "threshold")


@query("select o_orderpriority as task_id, count(*) as shots, count(*) filter (where o_orderkey % 7 = 0) as failures, round(sum(o_orderkey % 100 / 4.0), 6) as cost from orders group by all")
def measured_shots(spark, sf_dir):
    """Orders as units that a measure of one's own turns into shots, batch by batch on the workers."""

    def measure(frame):
        seed = frame["seed"]
        return frame.assign(failed=seed % 7 == 0, cost=seed % 100 / 4.0)

    units = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("task_id"), F.col("o_orderkey").alias("seed"))
    shots = fold.collected(spark, units, measure, "task_id string, seed long, failed boolean, cost double")
    return shots.groupBy("task_id").agg(F.count("*").alias("shots"), F.count_if("failed").alias("failures"), F.round(F.sum("cost"), 6).alias("cost"))


@query("select l_suppkey, count(*) filter (where l_returnflag = 'R') as R, count(*) filter (where l_returnflag = 'A') as A, count(*) filter (where l_returnflag not in ('R', 'A')) as other from lineitem group by all")
def counts_by_kind(spark, sf_dir):
    return A.count_by_kind(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_returnflag", ["R", "A"])


@query("select l_suppkey, round(avg(l_quantity), 9) as l_quantity_mean, max(l_quantity) as l_quantity_max, round(avg(l_tax), 9) as l_tax_mean, max(l_tax) as l_tax_max from lineitem group by all")
def means_and_maxima(spark, sf_dir):
    out = A.mean_and_max(table(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_quantity", "absent", "l_tax"])
    return out.withColumns({c: F.round(c, 9) for c in ("l_quantity_mean", "l_tax_mean")})


@query("select l_orderkey, min(l_partkey) as first, max(l_suppkey + l_partkey) as last, max(l_suppkey + l_partkey) - min(l_partkey) as life from lineitem where l_returnflag <> 'R' group by all")
def stage_lives(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").withColumn("done", F.col("l_suppkey") + F.col("l_partkey"))
    return measures.stage_life(line, ["l_orderkey"], "l_partkey", "done", F.col("l_returnflag") == "R")


@query(f"select event_id, (tick // 1000) / {S.TICKS_A_MICROSECOND}.0 as us, cast(floor(value * {S.TICKS_A_MICROSECOND} + 0.5) as bigint) as ticks from {EVENTS}")
def tick_units(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", S.to_microseconds(F.floor(F.col("tick") / 1000).cast("long")).alias("us"), S.to_ticks(F.col("value")).alias("ticks"))


@query("select role, count(*) as n, count(*) filter (where starts_with(conv_id || ':' || turn, (conv_id % 12)::varchar || ':')) as own from conversations group by all")
def requests_of_windows(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    request, key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")), (F.col("conv_id") % 12).cast("string")
    return c.groupBy("role").agg(F.count("*").alias("n"), F.count_if(S.requests_window(request, key)).alias("own"))


@query("select o_orderkey, (o_custkey % 9 + 3) - 6 > 0 and o_custkey % 4 < (o_custkey % 9 + 3) - 6 and o_orderkey % 7 >= (o_custkey % 9 + 3) - 6 as by_memory from orders")
def released_by_memory(spark, sf_dir):
    """Windows of 6 local rounds that memory alone lets go: what they read beyond is stored, and their successor has not got so far."""
    o = table(spark, sf_dir, "orders")
    flag = R.by_memory_only(F.col("o_custkey") % 9 + 3, F.lit(6), F.col("o_custkey") % 4, F.col("o_orderkey") % 7)
    return o.select("o_orderkey", flag.alias("by_memory"))
