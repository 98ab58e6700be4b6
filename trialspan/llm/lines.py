"""Removal of lines that many documents share.

Normalised lines are exploded and hashed, the distinct documents of each hash are counted, lines at or
over the threshold are dropped, and what is left is put together again by position.

A line's key is the line without blanks and \\x09-\\x0D at both ends, A-Z in lower case; it is known
by its 128-bit digest. Pairs of line and document are made distinct on both before they are
counted, so a line that a third of all documents hold is counted in partial sums. What a row
loses is gathered by a hash of its id and text, as many digests as that text has lines at most;
all of them are frequent everywhere, so rows whose hashes meet lose nothing more.

Defined cases: a null or an empty text is one empty line, which is never dropped, as no line
without a key is; a text that loses all its lines is empty. Rows that repeat an id are one
document when documents are counted, and so are all rows without an id; each row is rewritten by
itself. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trialspan.llm._arrays import LOWER, lean
from trialspan.llm._store import bounded_batches, col, written

#: Documents from which on a line is dropped.
LEAST = 10
_BLANK = b" \t\n\v\f\r"
_LOWER = LOWER.tobytes()


def _digests(text: bytes) -> Iterator[bytes | None]:
    """The digest of each line's key, None for lines without one."""
    for line in text.split(b"\n"):
        key = line.strip(_BLANK).translate(_LOWER)
        yield blake2b(key, digest_size=16).digest() if key else None


def _bytes(column: pa.Array) -> Iterator[bytes]:
    for text in column:
        yield text.as_buffer().to_pybytes() if text.is_valid else b""


def _exploded(rows: DataFrame) -> DataFrame:
    """(key, line): the distinct digests of each row of (key, text)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for k, text in enumerate(_bytes(batch.column(1))):
                own = set(_digests(text)) - {None}
                at.extend([k] * len(own))
                found.extend(own)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.binary())], names=["key", "line"])

    return rows.mapInArrow(run, StructType().add("key", rows.schema[0].dataType).add("line", "binary"))


def frequent(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(line, n_docs): digests of the lines in at least so many documents."""
    pairs = _exploded(docs.select(col(doc_id).alias("key"), col(text).alias("text"))).distinct()
    return pairs.groupBy("line").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= least)


@lean
def _reassembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        many, kept = [], []
        for text, gone in zip(_bytes(batch.column("text")), batch.column("gone"), strict=True):
            lines = text.split(b"\n")
            many.append(len(lines))
            if gone.is_valid:
                lost = set(gone.as_py())
                lines = [line for line, digest in zip(lines, _digests(text), strict=True) if digest not in lost]
            kept.append((b"\n".join(lines), len(lines)))
        columns = [batch.column(0), pa.array(many, pa.int64()), pa.array([m - n for m, (_, n) in zip(many, kept, strict=True)], pa.int64()), pa.array([k for k, _ in kept], pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "n_lines", "n_dropped", "kept"])


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) for each row of docs."""
    bounded_batches(docs.sparkSession)
    common = written(frequent(docs, doc_id, text, least).select("line"), "lines")
    rows = docs.select(F.xxhash64(col(doc_id), col(text)).alias("key"), col(doc_id).alias("id"), col(text).alias("text"))
    gone = _exploded(rows.select("key", "text")).join(common, "line", "left_semi").groupBy("key").agg(F.collect_set("line").alias("gone"))
    rows = rows.hint("merge").join(written(gone, "gone"), "key", "left").select("id", "text", "gone")
    out = rows.mapInArrow(_reassembled, StructType().add("id", rows.schema["id"].dataType).add("n_lines", "long").add("n_dropped", "long").add("kept", "string"))
    return out.select(col("id").alias(doc_id), "n_lines", "n_dropped", F.col("kept").alias("kept_text"))
