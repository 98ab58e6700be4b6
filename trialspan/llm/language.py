"""Language identification by prediction by partial matching.

Per language one byte-context tree with escape probabilities is counted over all labelled
training rows; a text goes to the language that codes it in the fewest bits. A-Z are folded to
lower case; all other bytes stand for themselves.

Defined cases: a null text, an empty one, or one without a letter has language `und` and score
0; with no training rows every text is `und`. Rows with a null or empty label do not train. Equal code
lengths go to the language that sorts first. Repeated rows are each predicted. Other columns
of the input are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trialspan.llm import _context
from trialspan.llm._arrays import LOWER, lean, slices
from trialspan.llm._store import bounded_batches, col, fresh

#: Bytes of text whose code-length difference decides the score; longer texts count as so many.
SCORE_BYTES = 64
#: Bits a byte without any model.
UNCODED = 8.0


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> list[_context.Models]:
    """The models of all languages from all rows of docs with a label, in blocks."""
    bounded_batches(docs.sparkSession)
    rows = docs.where(col(lang).isNotNull() & (col(lang) != "") & col(text).isNotNull())
    return _context.fit(rows.select(col(lang).alias("label"), col(text).alias("text")), LOWER)


class _Best:
    """The best language of each text so far, its bits, and the mass of all: the sum of 2 ** -(bits more than the best, per SCORE_BYTES)."""

    def __init__(self, rows: int):
        self.name = np.full(rows, None, object)
        self.bits, self.mass = np.full(rows, np.inf), np.zeros(rows)

    def add(self, column: pa.Array, block: _context.Models) -> None:
        for i, j, off, data in slices(column):
            total = block.summed(_context.packed(data, off, LOWER), off)
            size = np.maximum(np.diff(off), 1)
            scale = np.minimum(size, SCORE_BYTES) / size
            low = total.min(1)
            bits = np.minimum(self.bits[i:j], low)
            with np.errstate(invalid="ignore"):
                before = np.where(np.isinf(self.bits[i:j]), 0.0, self.mass[i:j] * np.exp2((bits - self.bits[i:j]) * scale))
            self.mass[i:j] = before + np.exp2((bits[:, None] - total) * scale[:, None]).sum(1)
            better = low < self.bits[i:j]
            self.name[i:j][better] = np.array(block.names, object)[total.argmin(1)[better]]
            self.bits[i:j] = bits


def _predicted(rows: DataFrame, models: list[_context.Models], at: int, emit: int) -> DataFrame:
    """The first `emit` columns of rows with lang_pred, score and bits_per_byte appended.

    Column `at` is the text and the last one tells whether it has a letter. Rows pass through
    one worker for each block of models, which is mostly one.
    """
    spark, names = rows.sparkSession, rows.columns[:emit]
    rows = rows.toDF(*(f"c{k}" for k in range(len(rows.columns))))  # Arrow functions take no dotted names
    base = rows.schema
    width = len(base)
    result = StructType(base.fields[:emit]).add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")
    partial = StructType(list(base.fields)).add("name", "string").add("bits", "double").add("mass", "double")
    for k, block in enumerate(models or [None]):
        last = k + 1 >= len(models)
        shared = spark.sparkContext.broadcast(block)

        @lean
        def predict(batches: Iterator[pa.RecordBatch], k=k, last=last, shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                best = _Best(len(batch))
                if k:
                    best.name = np.array(batch.column(width).to_pylist(), object)
                    best.bits, best.mass = (batch.column(width + 1 + j).to_numpy().copy() for j in range(2))
                if shared.value is not None:
                    best.add(batch.column(at), shared.value)
                if not last:
                    yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(best.name, pa.string()), pa.array(best.bits), pa.array(best.mass)], names=partial.names)
                    continue
                letters = batch.column(width - 1).to_numpy(zero_copy_only=False).astype(bool) & ~np.isinf(best.bits)
                size = np.maximum(_bytes(batch.column(at)), 1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:emit], pa.array(np.where(letters, best.name, "und"), pa.string()), pa.array(np.where(letters, 1.0 / np.maximum(best.mass, 1.0), 0.0)), pa.array(np.where(np.isinf(best.bits), 0.0, best.bits) / size)], names=result.names)

        rows = rows.mapInArrow(predict, result if last else partial)
    return rows.toDF(*names, "lang_pred", "score", "bits_per_byte")


def _bytes(column: pa.Array) -> np.ndarray:
    out = np.zeros(len(column), np.int64)
    for i, j, off, _ in slices(column):
        out[i:j] = np.diff(off)
    return out


def _letters(text: str) -> Column:
    return F.coalesce(col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters")


def identify(docs: DataFrame, models: list[_context.Models], keep: list[str], text: str = "text") -> DataFrame:
    """The columns named in keep, with lang_pred, score and bits_per_byte, for each row of docs."""
    rows = docs.select(*(col(c) for c in keep), col(text).alias("text"), _letters(text))
    return _predicted(rows, models, len(keep), len(keep))


def known(docs: DataFrame, models: list[_context.Models], text: str = "text") -> DataFrame:
    """docs, all columns, without the rows that identify() calls `und` and those that the best model codes no better than equally likely bytes."""
    columns = docs.columns
    own = [fresh(c, columns) for c in ("lang_pred", "score", "bits_per_byte")]
    rows = docs.select(*(col(c) for c in columns), _letters(text))
    at = [c.lower() for c in columns].index(text.lower())
    found = _predicted(rows, models, at, len(columns)).toDF(*columns, *own)
    return found.where((col(own[0]) != "und") & (col(own[2]) < UNCODED)).select(*(col(c) for c in columns))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """True for the fifth of the ids that never trains."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
