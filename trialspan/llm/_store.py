"""Intermediate tables in the folder that all executors share, so that no lineage is recomputed and a lost executor loses nothing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}
#: Paths of the tables that were written and not dropped, in order.
_MADE: list[str] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where it is unset and the master is local (tests), a temporary folder of this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = _FALLBACK.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="trialspan-"))
    return where.rstrip("/")


def written(df: DataFrame, name: str, *stats: Column) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again. The columns keep their names, types and order.

    Aggregates given as stats are taken in the same pass and are in the attribute `stats` of the result.
    """
    path = f"{folder(df.sparkSession)}/trialspan/{name}-{uuid.uuid4().hex}"
    seen = Observation() if stats else None
    with _shuffles_end(df.sparkSession):
        (df.observe(seen, *(s.alias(f"s{k}") for k, s in enumerate(stats))) if seen else df).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._trialspan_path = path
    _MADE.append(path)
    trimmed(df.sparkSession)
    out.stats = [seen.get[f"s{k}"] for k in range(len(stats))] if seen else []
    return out


@contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs within go when it has run, and not when the driver happens to collect its plans: nothing reads them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def dropped(*tables: DataFrame) -> None:
    """Removes tables that written() made and nothing reads any more."""
    for df in tables:
        path = getattr(df, "_trialspan_path", None)
        if path:
            _removed(df.sparkSession, path)


def _removed(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _MADE:
        _MADE.remove(path)


def standing() -> frozenset[str]:
    """The tables that were made and not removed, by their paths."""
    return frozenset(_MADE)


def swept(before: frozenset[str], kept: DataFrame) -> None:
    """Removes the tables that were made since, but for the one that was made of them and is kept."""
    for path in [p for p in _MADE if p not in before and p != kept._trialspan_path]:
        _removed(kept.sparkSession, path)


def trimmed(spark: SparkSession) -> None:
    """Lets the driver's JVM give native memory that it freed back to the system, as a worker does; many short jobs leave much of it."""
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    of = jvm.java.lang.Class.forName
    types, values = new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
    for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        types[k] = of(name)
    values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        of("javax.management.MBeanServer").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:  # other JVMs and systems lack the command
        return


#: Rows of a few numbers that may be broadcast, 4 to 16 MB; beyond them a join is shuffled.
NARROW = 250_000


def narrow(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, to be broadcast if its rows, counted here unless given, are few enough."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= NARROW else df


#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on the bytes of an Arrow batch, 64 MB by default, so that a worker and its executor hold little of a partition at once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def col(name: str) -> Column:
    """The column of that very name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(name: str, columns: list[str]) -> str:
    """name, lengthened until it clashes with no column in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
