"""File listings and small files through Spark's file systems, so that any path that Spark reads works."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _at(spark, path)
    return bool(fs.exists(where))


def is_file(spark: SparkSession, path: str) -> bool:
    where, fs = _at(spark, path)
    return bool(fs.exists(where)) and bool(fs.getFileStatus(where).isFile())


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below path."""
    where, fs = _at(spark, path)
    return fs.getContentSummary(where).getLength()


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in path, hidden and staging ones left out, in order."""
    where, fs = _at(spark, path)
    if not fs.exists(where):
        return []
    found = (s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory())
    return sorted(n for n in found if n[0] not in "._")


def rename(spark: SparkSession, old: str, new: str) -> bool:
    """Moves a folder in one step; False if the new name is taken."""
    (a, fs), (b, _) = _at(spark, old), _at(spark, new)
    fs.mkdirs(b.getParent())
    return not fs.exists(b) and bool(fs.rename(a, b))


def remove(spark: SparkSession, path: str) -> None:
    where, fs = _at(spark, path)
    fs.delete(where, True)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).head()[0]


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(read_text(spark, path))


def write_text(spark: SparkSession, text: str, path: str) -> None:
    where, fs = _at(spark, path)
    out = fs.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def hashes(spark: SparkSession, folder: str, names: str) -> DataFrame:
    """(name, sha256) of the files of a folder whose names fit."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", names).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))
