"""Session defaults of the engine."""

from __future__ import annotations

import sys
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.cloudpickle import cloudpickle
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.datasource import DataSource

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "trialspan", **conf: str) -> SparkSession:
    """A session with the engine's defaults; keyword arguments name settings with `_` for `.`."""
    builder = SparkSession.builder.appName(name)
    for key, value in (DEFAULTS | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset and the master is local (tests), a temporary folder of this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = _OWN.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="trialspan-"))
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def staged(df: DataFrame, name: str, **stats: Column) -> tuple[DataFrame, dict]:
    """df written once to the shared folder and read again, and aggregates of its rows taken in the same pass."""
    seen, path = Observation(), fresh_path(df.sparkSession, name)
    (df.observe(seen, *(c.alias(k) for k, c in stats.items())) if stats else df).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._trialspan_path = path
    return out, seen.get if stats else {}


def dismissed(*tables: DataFrame) -> None:
    """Removes tables that staged() made and nothing reads any more."""
    for df in tables:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._trialspan_path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers, once a context, so that they need no installation or shared folder."""
    sc = spark.sparkContext
    if not getattr(sc, "_trialspan_shipped", False):
        root = Path(__file__).resolve().parent
        archive = f"{tempfile.mkdtemp(prefix='trialspan-')}/trialspan.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, f"trialspan/{path.relative_to(root)}")
        sc.addPyFile(archive)
        sc._trialspan_shipped = True
    return spark


@contextmanager
def by_value(module: str) -> Iterator[None]:
    """What is pickled within carries the code of the module, for workers that do not see the files sent to tasks: those that plan data sources and start stateful processors."""
    code = sys.modules[module]
    cloudpickle.register_pickle_by_value(code)
    try:
        yield
    finally:
        cloudpickle.unregister_pickle_by_value(code)


def register(spark: SparkSession, source: type[DataSource]) -> None:
    """Registers a Python data source with its code."""
    with by_value(source.__module__):
        spark.dataSource.register(source)
