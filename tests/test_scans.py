"""Blocked scans against plain windows, folds against loops, graphs with cycles, nested blocks, the sweep row."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from trialspan import cli
from trialspan.functions import scalars as S
from trialspan.operators import analytic, folds, graph, joins, scans
from trialspan.plans import sweep, sweeps
from trialspan.sources import files, sinks
from trialspan.sources import scans as io


def rows_of(spark, n=3000, seed=1):
    """One key holds two thirds of all rows; ticks repeat, keys and values may be null."""
    rng = random.Random(seed)
    rows = [("hot" if k % 3 else rng.choice(["a", "b", None]), rng.randrange(900), k, rng.choice([None, 1, 2, 7]), rng.random()) for k in range(n)]
    return spark.createDataFrame(rows, "k string, t long, i long, v long, x double").repartition(4), rows


def same(a, b):
    order = lambda r: tuple(str(x) for x in r)
    names = sorted(a.columns)
    assert names == sorted(b.columns)
    assert sorted(map(tuple, a.select(names).collect()), key=order) == sorted(map(tuple, b.select(names).collect()), key=order)


def test_running_sums_and_maxima_over_blocks(spark):
    df, _ = rows_of(spark)
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, 0)
    plain = df.withColumns({"total": F.sum("v").over(w), "high": F.max("x").over(w)})
    for rows in (10**9, 500, 37):
        same(scans.running(df, ["k"], ["t", "i"], {"total": "v"}, {"high": "x"}, rows), plain)
    blocks = scans.blocked(df, "t", 100).where("k = 'hot'").groupBy("__block").count().collect()
    assert len(blocks) > 20 and max(b["count"] for b in blocks) < 200  # a key of two thirds of all rows is many tasks' work


def test_one_value_of_the_order_is_never_cut(spark):
    df = spark.range(1000).select(F.lit("k").alias("k"), F.lit(5).alias("t"), F.col("id").alias("i"), F.lit(1).alias("v"))
    assert scans.blocked(df, "t", 10).select("__block").distinct().count() == 1
    out = scans.running(df, ["k"], ["t", "i"], {"n": "v"}, rows=10)
    assert sorted(r.n for r in out.collect()) == list(range(1, 1001))
    empty = scans.running(df.limit(0), ["k"], ["t", "i"], {"n": "v"}, rows=10)
    assert empty.count() == 0


def test_blocked_forms_equal_plain_ones(spark):
    df, _ = rows_of(spark, 1500)
    jobs = df.withColumn("s", F.coalesce("v", F.lit(3)))
    same(scans.serial_channel(jobs, ["k"], ["t", "i"], "t", "s", 4, rows=50).where("k is not null"), analytic.serial_channel(jobs, ["k"], ["t", "i"], "t", "s", 4).where("k is not null"))
    levels = df.withColumn("v", F.coalesce("v", F.lit(0)))
    for end, start in ((None, None), (F.lit(950), F.lit(300))):
        same(scans.level_summary(levels, ["k"], "t", "i", "v", end, start, rows=60), analytic.level_summary(levels, ["k"], "t", "i", "v", end, start))
    spans = df.select("k", F.col("t").alias("a"), (F.col("t") + F.col("i") % 50).alias("b"))
    same(scans.sweep_line_peak(spans, ["k"], "a", "b", rows=60), analytic.sweep_line_peak(spans, ["k"], "a", "b"))
    right = df.where("v = 7").groupBy("k", "t").agg(F.max("i").alias("last"))
    left = df.where("v is null").select("k", "t", "i")
    for rows in (40, 10**9):
        same(scans.asof(left, right, ["k"], "t", "last", rows=rows).where("k is not null"), joins.asof(left, right, ["k"], "t", "last").where("k is not null"))


def test_folds_hand_their_state_on(spark):
    df, rows = rows_of(spark, 800)
    out = {r.k: (r.n, r.digest) for r in folds.folded(df, ["k"], ["t", "i"], ["i", "v"], lambda: (0, ""), lambda s, r: (s[0] + 1, hashlib.md5((s[1] + f"{r[0]}").encode()).hexdigest()), "n long, digest string").collect()}
    for key in {r[0] for r in rows}:
        n, digest = 0, ""
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3]):
            n, digest = n + 1, hashlib.md5((digest + f"{r[2]}").encode()).hexdigest()
        assert out[key] == (n, digest)
    assert len(out) == 4
    same(folds.adaptive_threshold(df, ["k"], "i", "x", 0.2, 0.5, 0.01), analytic.adaptive_threshold(df, ["k"], "i", "x", 0.2, 0.5, 0.01))
    plan = folds.adaptive_threshold(df, ["k"], "i", "x", 0.2, 0.5, 0.01)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Sort" in plan
    texts = df.select("k", "t", "i", F.when(F.col("v") == 1, None).otherwise(F.col("i").cast("string")).alias("text"))
    digests = {r.k: r.digest for r in folds.ordered_digest(texts, ["k"], ["t", "i"], "text").collect()}
    for key in digests:
        kept = [str(r[2]) for r in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3]) if r[3] != 1]
        assert digests[key] == hashlib.sha256("|".join(kept).encode()).hexdigest()


def test_closure_takes_the_longest_paths(spark):
    rng = random.Random(5)
    for n in (1, 40):
        edges = sorted({(a, b) for a in range(n) for b in rng.sample(range(a), min(a, 3))} | {(k, k - 1) for k in range(1, n, 2)})
        depth = {}
        for a in range(n):
            for b in (q for p, q in edges if p == a):
                depth[a, b] = max(depth.get((a, b), 0), 1)
                for (p, c), d in list(depth.items()):
                    if p == b:
                        depth[a, c] = max(depth.get((a, c), 0), d + 1)
        df = spark.createDataFrame(edges, "c long, p long") if edges else spark.createDataFrame([], "c long, p long")
        assert {(r.child, r.ancestor): r.depth for r in graph.closure(df, "c", "p").collect()} == depth
    with pytest.raises(ValueError, match="cycle"):
        graph.closure(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "c long, p long"), "c", "p")


def test_exactly_the_nodes_of_cycles(spark):
    """Tails in, tails out, and a path between two cycles are on none."""
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 7), (7, 5), (8, 1), (9, 8), (7, 10), (10, 11), (12, 12), (13, None)]
    df = spark.createDataFrame(edges, "c long, p long")
    assert sorted(r.node for r in graph.cycle_nodes(df, "c", "p").collect()) == [1, 2, 3, 5, 6, 7, 12]
    assert graph.cycle_nodes(df.where("c in (4, 8, 9, 10)"), "c", "p").count() == 0
    nodes = spark.createDataFrame([(k,) for k in range(1, 13)] + [(4,)], "n long")
    found = sorted(map(tuple, graph.validated(nodes, df.where("p is not null").unionByName(spark.createDataFrame([(2, 99)], "c long, p long")), "n", "c", "p", cycles=True).collect()))
    assert found == [("cycle", k) for k in (1, 2, 3, 5, 6, 7, 12)] + [("repeated", 4), ("unknown", 99)]


MODEL = """
# a model
error(0.1) D0 D3 L0
repeat 3 {
    error(0.2) D1 ^ D2
    repeat 2 {
        shift_detectors(1, 0) 5
        error(0) D0
        repeat 0 {
            error(0.9) D9
            shift_detectors 100
        }
        repeat 2 {
            error[tag](0.3) D0 L1
            shift_detectors 1
        }
    }
    detector(1, 2) D4
    shift_detectors 2
}
error(0.4) D0 D1
"""


def turned(lines):
    """The model run line by line."""
    out, shift, at = [], 0, 0

    def block(first):
        nonlocal shift, at
        k = first
        while k < len(lines):
            line = lines[k].strip()
            if line.startswith("error"):
                p = float(line[line.index("(") + 1 : line.index(")")])
                names = line[line.index(")") + 1 :].split()
                if p > 0:
                    out.append((at, p, [int(x[1:]) + shift for x in names if x[0] == "D"], [int(x[1:]) for x in names if x[0] == "L"]))
                at += 1
            elif line.startswith("shift"):
                shift += int(line.split()[-1])
            elif line.startswith("repeat"):
                times, body = int(line.split()[1]), k + 1
                for _ in range(times):
                    k = block(body)
                if not times:
                    depth = 1
                    while depth:
                        k += 1
                        depth += lines[k].strip().startswith("repeat") - (lines[k].strip() == "}")
            elif line == "}":
                return k
            k += 1
        return k

    block(0)
    return out


def test_nested_blocks_with_shifts(spark, tmp_path):
    files.write_text(spark, MODEL, f"{tmp_path}/m.dem")
    found = io.error_model(spark, f"{tmp_path}/m.dem").orderBy("ordinal").collect()
    assert [(r.ordinal, r.probability, r.detectors, r.observables) for r in found] == turned(MODEL.split("\n"))
    assert len(found) == 1 + 3 * (1 + 2 * 2) + 1
    files.write_text(spark, "# nothing\n", f"{tmp_path}/e.dem")
    assert io.error_model(spark, f"{tmp_path}/e.dem").count() == 0


def test_sweep_row_with_limits(spark):
    shots = spark.createDataFrame([("a", "uf", s, s % 4 == 0, s % 5 != 0, 3, s % 2) for s in range(20)], "task_id string, algorithm string, seed long, logical_failure boolean, is_scored boolean, decoded_windows long, escalated_windows long")
    prefixes = spark.createDataFrame([("a", 20, 16, 4, "cap")], "task_id string, shots long, scored long, failures long, state string")
    row = sweep.rows(shots, None, prefixes, F.lit(10)).head()
    assert (row.shots, row.logical_failures, row.scored_shots, row.unscored_shots, row.windows_per_shot) == (20, 5, 16, 4, 3.0)
    assert row.logical_error_rate_low < row.logical_error_rate_estimate == 0.25 < row.logical_error_rate_high and row.logical_error_rate_plan_unbiased == 0.25
    assert row.logical_error_rate_per_round_low < row.logical_error_rate_per_round < 0.25 and not row.is_shot_rate_above_half
    assert "logical_error_rate_estimate" not in sweep.rows(shots, None, prefixes, adaptive=True).columns


def test_identities_nest(spark):
    rows = [("a", "b:1"), ("", "x"), (None, "-"), ("12:3", None)]
    df = spark.createDataFrame(rows, "a string, b string").withColumn("i", S.nested_identity(F.col("a"), S.nested_identity(F.col("b"), F.col("a"))))
    out = df.select("a", "b", S.identity_parts(F.col("i")).alias("p")).withColumn("q", S.identity_parts(F.col("p")[1])).collect()
    assert all(r.p[0] == r.a and r.q == [r.b, r.a] for r in out)
    assert df.select("i").distinct().count() == 4
    assert spark.range(1).select(S.identity_parts(F.lit("plain")).alias("p"), S.identity_parts(S.nested_identity()).alias("q")).head() == (None, [])
    ids = spark.range(1).select(S.content_id(a=F.lit(1), b=F.lit("x")).alias("x"), S.content_id(b=F.lit("x"), a=F.lit(1)).alias("y")).head()
    assert ids.x == ids.y


def test_headers_of_many_pieces_in_one_scan(spark, tmp_path):
    df = spark.range(20).select("id", (F.col("id") * 2).alias("two"))
    for k in range(3):
        sinks.write_csv([df.repartition(2)], f"{tmp_path}/p{k}")
    found = io.headers_of(spark, [f"{tmp_path}/p{k}" for k in range(3)])
    assert found == {f"{tmp_path}/p{k}": ["id", "two"] for k in range(3)}


def test_sweeps_name_their_tasks(spark, tmp_path):
    text = json.dumps({"name": "s", "axes": {"d": [3, 5], "p": [0.1]}, "constants": {"rounds": 9}, "stop": {"target": 3, "minimum": 1, "cap": 40}, "skip": [{"d": 5, "p": 0.1}]})
    files.write_text(spark, text, f"{tmp_path}/sweep.json")
    s = sweeps.load(spark, f"{tmp_path}/sweep.json")
    assert [(t.task_id, t.values) for t in s.tasks()] == [("s-d=3-p=0.1", {"d": 3, "p": 0.1, "rounds": 9})] and s.stop == {"target": 3, "minimum": 1, "cap": 40}
    assert sweeps.table(spark, s).select("task_id", "d", "rounds").collect() == [("s-d=3-p=0.1", 3, 9)]
    with pytest.raises(ValueError, match="stop"):
        sweeps.Sweep("s", {"d": [1]}, stop={"targets": 3})


def test_collect_and_share_from_the_command_line(spark, tmp_path, capsys):
    files.write_text(spark, json.dumps({"name": "s", "axes": {"d": [3, 5]}, "stop": {"target": 3, "minimum": 1, "cap": 40}}), f"{tmp_path}/sweep.json")
    measure = "trialspan.plans.sweeps:coin"
    assert cli.main(["collect", f"{tmp_path}/sweep.json", f"{tmp_path}/one", measure, "--batch", "4"]) == 0
    one = capsys.readouterr().out
    assert "s-d=3" in one and "target" in one
    for k in range(2):
        assert cli.main(["share", f"{tmp_path}/sweep.json", f"{tmp_path}/two", measure, "--seeds", "30", "--part", str(k), "--parts", "2"]) == 0
    assert cli.main(["info", f"{tmp_path}/two"]) == 0
    assert "s-d=3 0+15 15+15" in capsys.readouterr().out


def test_stream_from_the_command_line(spark, tmp_path, capsys):
    assert cli.main(["stream", f"{tmp_path}/out", "--streams", "3", "--rounds", "40", "--warmup", "10", "--step", "9"]) == 0
    told = [json.loads(line) for line in capsys.readouterr().out.splitlines() if line.startswith("{")]
    assert [(t["stream_id"], t["rounds"], t["windows"]) for t in told] == [(k, 30, 11) for k in range(3)]


def test_records_have_eleven_tables_and_join(spark, tmp_path):
    from trialspan.schemas import RECORD

    assert len(RECORD) == 11
    counts = spark.createDataFrame([("a", "uf", "p", "weak", 5, 2), ("b", "uf", "p", "weak", 5, 1)], "task_id string, algorithm string, point string, tier string, value_us long, count long")
    sinks.write_record({"latency_samples": counts}, f"{tmp_path}/one")
    sinks.write_record({"latency_samples": counts.where("task_id = 'a'")}, f"{tmp_path}/two")
    both = io.read_record(spark, [f"{tmp_path}/one", f"{tmp_path}/two"], "latency_samples")
    assert sorted((r.task_id, r["count"]) for r in both.collect()) == [("a", 4), ("b", 1)]
    with pytest.raises(ValueError, match="no table"):
        sinks.write_record({"other": counts}, f"{tmp_path}/three")
    with pytest.raises(ValueError, match="lacks"):
        sinks.write_record({"shot_links": counts}, f"{tmp_path}/three")
