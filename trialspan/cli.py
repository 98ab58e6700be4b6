"""Commands: collect, share, fold, stream, trace, info, queries, query, check, params."""

from __future__ import annotations

import argparse
import json
from importlib import import_module

from pyspark.sql import functions as F

from trialspan.operators import measures
from trialspan.plans import catalogue, fold, sweeps
from trialspan.session import DEFAULTS, register, session, ship
from trialspan.sources import files, rounds, scans
from trialspan.streaming import rounds as streams

#: Columns of a measured shot.
SHOTS = "task_id string, algorithm string, seed long, failed boolean, scored boolean"
TYPES = {"seed": "long", "failed": "boolean", "scored": "boolean"}


def _named(name: str):
    module, _, function = name.partition(":")
    return getattr(import_module(module), function)


def _streamed(spark, a) -> None:
    """Runs live rounds to their end, measured as they come: a JSON record for each stream, past its warm-up."""
    register(spark, rounds.RoundSource)
    source = spark.readStream.format("rounds").options(streams=a.streams, rounds=a.rounds, step=a.step, seed=a.seed).load()
    late = source.where(F.col("round_index") > a.warmup)
    counted = late.select("stream_id", F.lit(1).cast("long").alias("rounds"), F.bit_count("bits").cast("long").alias("set_bits"))
    ended = lambda stream: stream.withColumn("last", F.lit(a.rounds).cast("long"))
    totals = streams.latest(counted, streams.added(["stream_id"], ["rounds", "set_bits"]), "append", f"{a.out}/totals", once=False)
    laid = streams.drained(streams.ready_windows(ended(source), "stream_id", "round_index", a.commit, a.buffer, "last"), path=f"{a.out}/windows", once=False)
    windows = laid.where(F.col("commit_hi") > a.warmup).groupBy("stream_id").agg(F.count(F.lit(1)).alias("windows"))
    for row in totals.join(windows, "stream_id", "left").orderBy("stream_id").toJSON().toLocalIterator():
        print(row)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="trialspan", description=__doc__)
    verbs = parser.add_subparsers(dest="verb", required=True)
    v = verbs.add_parser("fold", help="fold the pieces of an experiment")
    v.add_argument("experiment"), v.add_argument("out"), v.add_argument("--types", default="{}"), v.add_argument("--target", type=int, default=100), v.add_argument("--cap", type=int, default=10**9)
    for verb, told in (("collect", "measure the tasks of a sweep until they stop"), ("share", "measure one share of the seeds of a sweep")):
        v = verbs.add_parser(verb, help=told)
        v.add_argument("sweep"), v.add_argument("experiment"), v.add_argument("measure", help="module:function of a frame of units")
        if verb == "collect":
            v.add_argument("--batch", type=int, default=100)
        else:
            v.add_argument("--seeds", type=int, required=True), v.add_argument("--part", type=int, required=True), v.add_argument("--parts", type=int, required=True)
    v = verbs.add_parser("stream", help="measure live streams of rounds")
    v.add_argument("out")
    for name, value in (("streams", 1), ("rounds", 1000), ("warmup", 0), ("step", 100), ("seed", 0), ("commit", 3), ("buffer", 2)):
        v.add_argument(f"--{name}", type=int, default=value)
    v = verbs.add_parser("trace", help="the path of one key through a trace")
    v.add_argument("path"), v.add_argument("kind"), v.add_argument("key")
    v = verbs.add_parser("info", help="tasks and pieces of an experiment")
    v.add_argument("experiment")
    verbs.add_parser("queries", help="names of all queries")
    v = verbs.add_parser("query", help="run a query over a folder of tables")
    v.add_argument("name"), v.add_argument("tables")
    v = verbs.add_parser("check", help="the plan of a query, without running it")
    v.add_argument("name"), v.add_argument("tables")
    verbs.add_parser("params", help="session settings")
    a = parser.parse_args(argv)
    if a.verb == "queries":
        print("\n".join(sorted(catalogue.queries())))
        return 0
    if a.verb == "params":
        print(json.dumps(DEFAULTS, indent=1))
        return 0
    spark = ship(session())
    if a.verb == "collect":
        sweep = sweeps.load(spark, a.sweep)
        fold.run_until_stopped(spark, a.experiment, [t.task_id for t in sweep.tasks()], _named(a.measure), SHOTS, TYPES, a.batch, **sweep.rules()).show(1000, truncate=False)
    elif a.verb == "share":
        first, last = a.seeds * a.part // a.parts, a.seeds * (a.part + 1) // a.parts
        for task in sweeps.load(spark, a.sweep).tasks():
            units = spark.range(first, last).select(F.lit(task.task_id).alias("task_id"), F.col("id").alias("seed"))
            fold.record(spark, a.experiment, fold.collected(spark, units, _named(a.measure), SHOTS), task.task_id, first, last - first)
    elif a.verb == "stream":
        _streamed(spark, a)
    elif a.verb == "fold":
        fold.fold(spark, a.experiment, a.out, json.loads(a.types), target=a.target, cap=a.cap).show(truncate=False)
    elif a.verb == "trace":
        measures.follow(scans.trace(spark, a.path), a.kind, a.key).select("ts", "dur", "lane", "cat", "name").show(1000, truncate=False)
    elif a.verb == "info":
        for task in files.folders(spark, a.experiment):
            print(task, *(f"{first}+{n}" for _, first, n, _ in scans.piece_folders(spark, a.experiment, [task])))
    elif a.verb == "query":
        catalogue.queries()[a.name](spark, a.tables).show(50, truncate=False)
    else:
        catalogue.queries()[a.name](spark, a.tables).explain("formatted")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
