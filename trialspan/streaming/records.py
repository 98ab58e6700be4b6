"""A streaming sink of JSON records, each micro-batch once.

Tasks write part files that nobody reads yet. Committing a batch writes one manifest under the
batch's number that names its parts, by a rename, so a batch is there whole or not at all. A
batch that is given again after its manifest stands adds nothing: its new parts go. Readers take
the parts that manifests name. Files are written through Arrow's file systems, so the path may be any that they open.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from trialspan.session import register


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _manifest(where: fs.FileSystem, path: str) -> dict:
    with where.open_input_stream(path) as f:
        return json.loads(f.read())


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int


class _Writer(DataSourceStreamWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[Row]) -> Part:
        where, root = _at(self.path)
        where.create_dir(f"{root}/parts")
        name, rows = f"{uuid.uuid4().hex}.json", 0
        with where.open_output_stream(f"{root}/parts/{name}") as out:
            for row in iterator:
                out.write(json.dumps(row.asDict(recursive=True), default=str).encode() + b"\n")
                rows += 1
        return Part(name, rows)

    def commit(self, messages: list[Part | None], batchId: int) -> None:
        where, root = _at(self.path)
        manifest = f"{root}/batches/{batchId:012d}.json"
        if where.get_file_info(manifest).type != fs.FileType.NotFound:
            self.abort(messages, batchId)
            return
        where.create_dir(f"{root}/batches")
        staged = f"{root}/parts/{uuid.uuid4().hex}.manifest"
        with where.open_output_stream(staged) as out:
            out.write(json.dumps({"batch": batchId, "parts": [m.name for m in messages if m and m.rows], "rows": sum(m.rows for m in messages if m)}).encode())
        where.move(staged, manifest)
        for m in messages:
            if m and not m.rows:
                where.delete_file(f"{root}/parts/{m.name}")

    def abort(self, messages: list[Part | None], batchId: int) -> None:
        """Removes parts that no manifest names; a batch may be aborted after its manifest stands, and then is there."""
        where, root = _at(self.path)
        manifest = f"{root}/batches/{batchId:012d}.json"
        known = _manifest(where, manifest)["parts"] if where.get_file_info(manifest).type != fs.FileType.NotFound else []
        for m in messages:
            if m and m.name not in known:
                where.delete_file(f"{root}/parts/{m.name}")


class RecordSink(DataSource):
    """format("records") with option path; append mode."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> StructType:
        raise NotImplementedError("read records with recorded()")

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return _Writer(self.options["path"])


def record(stream: DataFrame, path: str, state: str) -> None:
    """Runs the stream to its end into the records under path; state is its checkpoint, with which it goes on when started again."""
    register(stream.sparkSession, RecordSink)
    stream.writeStream.format("records").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def recorded(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The records of all committed batches."""
    where, root = _at(path)
    manifests = where.get_file_info(fs.FileSelector(f"{root}/batches", allow_not_found=True))
    names = [name for m in sorted(manifests, key=lambda m: m.path) for name in _manifest(where, m.path)["parts"]]
    return spark.read.schema(schema).json([f"{path}/parts/{n}" for n in names]) if names else spark.createDataFrame([], schema)
