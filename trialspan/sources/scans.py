"""Scans: CSV pieces with typed cells, JSON records and traces, saved datasets, model and schedule texts."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialspan.schemas import RECORD
from trialspan.session import staged
from trialspan.sources import files


def header_of(spark: SparkSession, path: str) -> list[str]:
    return spark.read.csv(path, header=True).columns


def text_rows(spark: SparkSession, path: str) -> DataFrame:
    """All cells as text; an empty cell is null."""
    return spark.read.csv(path, header=True, inferSchema=False, escape='"')


def boolean_cell(c: Column) -> Column:
    return F.when(c.isin("True", "true"), True).when(c.isin("False", "false"), False)


def kind_of(c: Column) -> Column:
    """boolean, long, double or string by trial in that order; null for an empty cell."""
    return F.when(c.isNull(), None).when(boolean_cell(c).isNotNull(), "boolean").when(c.try_cast("long").isNotNull() & c.rlike(r"^[+-]?\d+$"), "long").when(c.try_cast("double").isNotNull(), "double").otherwise("string")


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Text cells cast to declared types; what does not fit is null."""
    return df.select(*((boolean_cell(F.col(c)) if types.get(c) == "boolean" else F.col(c).try_cast(types[c]) if c in types else F.col(c)).alias(c) for c in df.columns))


def typed_by_trial(df: DataFrame) -> DataFrame:
    """Each column in the narrowest type that all its cells have."""
    order = ["boolean", "long", "double", "string"]
    found = df.agg(*(F.collect_set(kind_of(F.col(c))).alias(c) for c in df.columns)).head()
    types = {}
    for c in df.columns:
        kinds = set(found[c])
        types[c] = "string" if "string" in kinds or {"boolean"} < kinds else max(kinds or {"string"}, key=order.index)
    return typed(df, types)


def piece_folders(spark: SparkSession, experiment: str, tasks: list[str] | None = None) -> list[tuple[str, int, int, str]]:
    """(task, first seed, seeds, path) of all whole pieces in the order of tasks and seeds."""
    out = []
    for task in tasks if tasks is not None else files.folders(spark, experiment):
        for name in files.folders(spark, f"{experiment}/{task}"):
            if m := re.fullmatch(r"(\d+)-(\d+)", name):
                out.append((task, int(m[1]), int(m[2]) - int(m[1]) + 1, f"{experiment}/{task}/{name}"))
    order = {t: k for k, t in enumerate(tasks or sorted({o[0] for o in out}))}
    return sorted(out, key=lambda o: (order[o[0]], o[1]))


def headers_of(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """The columns of CSV files or folders of them, all read in one scan: of each file its first line."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"))
    first = lines.groupBy("file").agg(F.min_by("value", "place").alias("line"))
    cells = F.split(first["line"], ",")  # names of columns hold no commas or quotes
    found = [(r["file"], r["cells"]) for r in first.select("file", cells.alias("cells")).collect()]
    tail = lambda path: re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "/", path).rstrip("/")
    folder = {tail(p): p for p in paths}
    out: dict[str, list[str]] = {}
    for name, columns in found:
        at = tail(name)
        path = folder.get(at) or folder[at.rpartition("/")[0]]
        if out.setdefault(path, columns) != columns:
            raise ValueError(f"files of {path} differ in their columns")
    return out


def piece_rows(spark: SparkSession, pieces: list[tuple[str, int, int, str]], name: str) -> DataFrame:
    """Rows of one table of many pieces, with task_id, first_seed and row order; pieces of one task must agree on columns."""
    found = headers_of(spark, [f"{path}/{name}" for _, _, _, path in pieces])
    headers: dict[str, list[str]] = {}
    for task, _, _, path in pieces:
        columns = found[f"{path}/{name}"]
        if headers.setdefault(task, columns) != columns:
            raise ValueError(f"pieces of {task} differ in their columns")
    groups: dict[tuple[str, ...], list[str]] = {}
    for task, _, _, path in pieces:
        groups.setdefault(tuple(headers[task]), []).append(f"{path}/{name}")
    out = None
    for columns, paths in groups.items():
        rows = spark.read.csv(paths, header=True, schema=", ".join(f"`{c}` string" for c in columns), escape='"')
        rows = rows.withColumns({"__path": F.col("_metadata.file_path"), "__place": F.monotonically_increasing_id()})
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    at = F.regexp_extract("__path", r"([^/]+)/(\d+)-\d+/[^/]+(?:/[^/]+)?$", 2).cast("long")
    return out.withColumn("first_seed", at)


def piece_facts(spark: SparkSession, experiment: str) -> DataFrame:
    """(task_id, first_seed, seeds, ...): what the documents of all whole pieces state."""
    facts = spark.read.option("pathGlobFilter", "piece.json").option("recursiveFileLookup", "true").json(experiment, multiLine=True)
    return facts.where(~F.col("_metadata.file_path").rlike(r"/_[^/]*/piece\.json$"))


def read_record(spark: SparkSession, folders: list[str], name: str) -> DataFrame:
    """One table of several records as one: rows together, counts of one row's name added."""
    law = RECORD[name]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (spark.read.parquet(f"{f}/{name}") for f in folders))
    return rows.groupBy(*law.keys).agg(*(F.sum(c).alias(c) for c in law.counts)) if law.counts else rows


def checked_state(spark: SparkSession, path: str, sha256: str) -> bytes:
    """The bytes of a saved state, whose hash must be the recorded one."""
    row = spark.read.format("binaryFile").load(path).select("content", F.sha2("content", 256).alias("h")).head()
    if row["h"] != sha256:
        raise ValueError(f"{path} is not what was saved")
    return bytes(row["content"])


def task_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents, one to a file, with the file's folder as task_id."""
    return spark.read.json(path, multiLine=True).withColumn("task_id", F.element_at(F.split("_metadata.file_path", "/"), -2))


#: Names of threads that may be broadcast; beyond them the join is shuffled.
LANES = 100_000
TRACE = "name string, cat string, ph string, ts double, dur double, pid long, tid long, args map<string,string>"


def trace(spark: SparkSession, path: str) -> DataFrame:
    """Events of trace documents, plain or gzip, with the name of their thread, from metadata rows, and their place."""
    head = spark.read.text(path).where("trim(value) <> ''").head()
    raw = spark.read.json(path, multiLine=not (head and head[0].lstrip().startswith("{")), schema=TRACE)  # one document, or one event a line
    lanes = raw.where("ph = 'M' and name = 'thread_name'").select("pid", "tid", F.col("args")["name"].alias("lane")).distinct()
    rows = raw.where("ph <> 'M'").withColumn("place", F.monotonically_increasing_id())
    return rows.join(F.broadcast(lanes) if lanes.limit(LANES + 1).count() <= LANES else lanes, ["pid", "tid"], "left")


def shot_dataset(spark: SparkSession, path: str, seed: int | None = None) -> DataFrame:
    """Saved shots; a seed reaches the scan as a pushed filter."""
    shots = spark.read.parquet(f"{path}/chunks")
    return shots if seed is None else shots.where(F.col("root_seed") == seed)


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """(name) of files that are missing or differ from a dataset's manifest."""
    manifest = json.loads(files.read_text(spark, f"{path}/manifest.json"))
    wanted = spark.createDataFrame(sorted(manifest["files"].items()), "name string, sha256 string")
    return wanted.join(files.hashes(spark, f"{path}/chunks", "*.parquet"), ["name", "sha256"], "left_anti").select("name")


def error_model(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, probability, detectors, observables) of the `error(p) D.. L..` instructions of a model in order, repeat blocks unrolled; dropped lines count in the ordinal."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("no", "line"))
    return unrolled(lines, [], "no", "line").where("probability > 0")


def unrolled(lines: DataFrame, keys: list[str], no: str, line: str) -> DataFrame:
    """(keys, ordinal, probability, detectors, observables) of every error of the models in lines, one model for each of keys.

    `repeat n {` and its `}`, each on a line of its own, may be nested; `shift_detectors n` moves the
    detectors of all that comes later. Nothing is run line by line: a block's shift and number of
    errors are sums over its lines, deepest blocks first; what comes before a line within its block
    is a running sum; and blocks become rows, one for each turn, with what came before the turn. The
    steps are as many as blocks are nested, whatever they repeat.
    """
    text = F.trim(F.col(line))
    at = Window.partitionBy(*keys).orderBy("no")
    depth = F.sum(F.when(F.col("kind") == "repeat", 1).when(F.col("kind") == "}", -1).otherwise(0)).over(at.rowsBetween(Window.unboundedPreceding, -1))
    number = lambda pattern: F.regexp_extract("text", pattern, 1).try_cast("long")
    rows = lines.select(*keys, (F.col(no).cast("long") + 1).alias("no"), text.alias("text"))
    rows = rows.withColumn("kind", F.regexp_extract("text", r"^(error|repeat|shift_detectors|\})", 1)).where("kind <> ''").withColumn("level", F.coalesce(depth, F.lit(0)))
    rows = rows.select(*keys, "no", "text", "kind", "level", F.when(F.col("kind") == "repeat", number(r"^repeat(?:\[.*?\])?\s+(\d+)")).alias("times"), F.when(F.col("kind") == "shift_detectors", number(r"(\d+)\s*(?:#.*)?$")).alias("shift"))
    rows, seen = staged(rows.where("kind <> '}'"), "model", deepest=F.max("level"))
    heads = rows.where("kind = 'repeat'").select(*keys, "no", (F.col("level") + 1).alias("level"), F.lit(None).cast("string").alias("kind"))
    inside = Window.partitionBy(*keys, "level").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    block = F.coalesce(F.last(F.when(F.col("kind").isNull(), F.col("no")), ignorenulls=True).over(inside), F.lit(0))
    rows = rows.unionByName(heads, allowMissingColumns=True).withColumn("block", block).where("kind is not null")
    deepest, sums, items = int(seen["deepest"] or 0), None, {}
    for level in range(deepest, -1, -1):  # what one turn of each block at this level adds
        here = rows.where(F.col("level") == level)
        if sums is None:
            here = here.withColumns({"turn_shift": F.lit(0).cast("long"), "turn_errors": F.lit(0).cast("long")})
        else:
            here = here.join(sums, [*keys, "no"], "left").fillna(0, ["turn_shift", "turn_errors"])
        here = here.withColumns({"own_shift": F.coalesce("shift", F.col("times") * F.col("turn_shift"), F.lit(0)), "own_errors": F.when(F.col("kind") == "error", 1).otherwise(F.coalesce(F.col("times") * F.col("turn_errors"), F.lit(0)))})
        earlier = Window.partitionBy(*keys, "block").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
        items[level] = here.withColumns({"before_shift": F.coalesce(F.sum("own_shift").over(earlier), F.lit(0)), "before_errors": F.coalesce(F.sum("own_errors").over(earlier), F.lit(0))})
        sums = here.groupBy(*keys, F.col("block").alias("no")).agg(F.sum("own_shift").alias("turn_shift"), F.sum("own_errors").alias("turn_errors"))
    zero = F.lit(0).cast("long")
    turns, out = None, []
    for level in range(deepest + 1):
        here = items[level].join(turns, [*keys, "block"]) if level else items[level].withColumns({"shift_at": zero, "errors_at": zero})
        here = here.withColumns({"shift_at": F.col("shift_at") + F.col("before_shift"), "errors_at": F.col("errors_at") + F.col("before_errors")})
        out.append(here.where("kind = 'error'").select(*keys, "text", F.col("errors_at").alias("ordinal"), "shift_at"))
        again = here.where("kind = 'repeat' and times > 0").select(*keys, F.col("no").alias("block"), "shift_at", "errors_at", "turn_shift", "turn_errors", F.explode(F.sequence(zero, F.col("times") - 1)).alias("turn"))
        turns = again.select(*keys, "block", (F.col("shift_at") + F.col("turn") * F.col("turn_shift")).alias("shift_at"), (F.col("errors_at") + F.col("turn") * F.col("turn_errors")).alias("errors_at"))
    found = reduce(DataFrame.unionByName, out)
    ids = lambda kind: F.transform(F.regexp_extract_all("text", F.lit(rf"\b{kind}(\d+)"), F.lit(1)), lambda x: x.cast("long"))
    shifted = F.transform(ids("D"), lambda d: d + F.col("shift_at"))
    return found.select(*keys, "ordinal", F.regexp_extract("text", r"^error(?:\[.*?\])?\(([^)]*)\)", 1).try_cast("double").alias("probability"), shifted.alias("detectors"), ids("L").alias("observables"))


def schedule(spark: SparkSession, path: str) -> DataFrame:
    """(id, kind, flag, cells, duration, before) of a schedule text, one instruction a line; its place is its id."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")).alias("id", "line"))
    lists = F.regexp_extract_all("line", F.lit(r"\[([^\]]*)\]"), F.lit(1))
    numbers = lambda text: F.transform(F.regexp_extract_all(text, F.lit(r"-?\d+"), F.lit(0)), lambda x: x.cast("long"))
    return lines.select(
        "id",
        F.regexp_extract("line", r"^\s*(\S+)", 1).alias("kind"),
        F.regexp_extract("line", r"^\s*\S+\s+(\S+)", 1).alias("flag"),
        F.transform(F.regexp_extract_all(F.try_element_at(lists, F.lit(1)), F.lit(r"\(([^)]*)\)"), F.lit(1)), numbers).alias("cells"),
        F.regexp_extract("line", r"\]\s+(\d+)", 1).try_cast("long").alias("duration"),
        numbers(F.coalesce(F.try_element_at(lists, F.lit(2)), F.lit(""))).alias("before"),
    )


def workload(spark: SparkSession, path: str) -> DataFrame:
    """Operation rows of an operations document, which is one JSON file, or a folder with a row a line."""
    where = f"{path}/operations.json"
    return spark.read.json(where, multiLine=files.is_file(spark, where))


def constants(text: str) -> dict[str, tuple[str, str]]:
    """dotted name -> (value, comment) of an indented `name: value  # source` text."""
    out: dict[str, tuple[str, str]] = {}
    path: list[tuple[int, str]] = []
    for line in text.splitlines():
        if m := re.match(r"^(\s*)([\w.-]+):\s*([^#]*?)\s*(?:#\s*(.*))?$", line):
            depth = len(m[1])
            path = [p for p in path if p[0] < depth] + [(depth, m[2])]
            if m[3]:
                out[".".join(p[1] for p in path)] = (m[3], m[4] or "")
    return out


def threshold_for(facts: DataFrame, table: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Facts with the threshold of a small table; the table's size is checked before it is sent to all workers."""
    small = table.select(*keys, value)
    return facts.join(F.broadcast(small) if small.count() <= 100_000 else small, keys, "left")
