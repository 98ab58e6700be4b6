"""Audit of how the sources of each language diverge in their terms.

A term is a run of letters, A-Z in lower case; all that is not ASCII is a letter. A language keeps the terms that at least LEAST
of its documents hold. Three steps count them:

1. Every task adds the document frequencies of its texts to a count-min sketch of ROWS rows and
   WIDTH cells each; the sketches are merged by addition. A cell never tells less than the
   frequency of any term in it. What goes back to the tasks is one bit a cell, whether it
   reaches LEAST: ROWS * WIDTH / 8 bytes, 2 MB, whatever the input.
2. Terms with a cell that falls short cannot be kept and are discarded where they are read, before any shuffle.
   The survivors are counted exactly for each (language, source, term), and those that only
   seemed frequent fall out by their exact counts.
3. Smoothed shares p of two sources are compared term by term. Terms that neither source has
   count alike, those that one has depend on its count alone; so only terms that both have are joined,
   and the rest is added from the histogram of each source's counts.

All arithmetic is in whole numbers, decimal where a product may leave 64 bits.

Defined cases: null text, language and source are ''. Each row is a document, repeated ids or
not. A language without a kept term has pairs of value 0 and no terms; a source that is alone in its language has no pair.
An empty table gives no rows. Ties are ranked by the bytes of the item. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspan.llm import _arrays as A
from trialspan.llm._store import bounded_batches, col, dropped, narrow, written

#: Documents of a language that hold a kept term, at least.
LEAST = 10
#: Ranks of terms that are returned.
TOP = 10
#: The sketch.
ROWS, WIDTH = 4, 1 << 22
#: Cells of a sketch that travel as one row.
CHUNK = 1 << 12
#: Bytes of whole texts looked at together.
SLICE = 2 << 20
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _coded(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    found = column.dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary


def _postings(text: pa.Array, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """(group, term, documents, occurrences, terms) of slices of whole texts: a row for each group of documents and term in it."""
    for i, j, off, data in A.slices(text, SLICE):
        data = A.LOWER[data]
        starts, ends, first = A.words(data, off, _LETTER)
        if not len(starts):
            continue
        n = ends - starts
        bounds = np.concatenate(([0], np.cumsum(n)))
        inside = np.repeat(starts - bounds[:-1], n) + np.arange(bounds[-1])
        words = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(bounds), pa.py_buffer(data[inside])])
        term, terms = _coded(words)
        doc = A.of_rows(first)
        pair, many = np.unique(doc * len(terms) + term, return_counts=True)  # once a document
        key, at = np.unique(group[i:j][pair // len(terms)] * len(terms) + pair % len(terms), return_inverse=True)
        yield key // len(terms), key % len(terms), np.bincount(at), np.bincount(at, many).astype(np.int64), terms


def _cells(lang: pa.Array, group: np.ndarray, terms: pa.Array, term: np.ndarray) -> np.ndarray:
    """The cell of each (language, term) in each row of the sketch, as numbers below ROWS * WIDTH."""
    langs, words = (_hashed(x) for x in (lang, terms))
    h = A.mix(words[term] + A.mix(langs)[group])
    return np.stack([(A.mix(h ^ A._LANES[r]) % np.uint64(WIDTH)).astype(np.int64) + r * WIDTH for r in range(ROWS)])


def _hashed(values: pa.Array) -> np.ndarray:
    out = np.zeros(len(values), np.uint64)
    for i, j, off, data in A.slices(values.cast(pa.large_binary()), SLICE):
        out[i:j] = A.spans(A.prefix(data), off[:-1], off[1:])
    return out


def sketched(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """(chunk, reached): the merged sketch of rows (lang, text) in chunks of CHUNK cells, one bit a cell that tells whether it reaches least.

    A task adds up its own sketch and sends the chunks that are not empty; chunks are added one by one as they come.
    """

    @A.lean
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(ROWS * WIDTH, np.uint32)
        for batch in batches:
            code, langs = _coded(batch.column("lang"))
            for lang, term, docs, _, terms in _postings(batch.column("text"), code):
                for cell in _cells(langs, lang, terms, term):
                    np.add.at(own, cell, docs.astype(np.uint32))
        own = own.reshape(-1, CHUNK)
        full = np.flatnonzero(own.any(1))
        for k in range(0, len(full), 256):
            part = full[k : k + 256]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([A.planes(own[c]) for c in part], pa.binary())], names=["chunk", "cells"])

    @A.lean
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(CHUNK, np.int64)
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], names=["chunk", "reached"])
        for batch in batches:
            for chunk, cells in zip(batch.column("chunk").to_pylist(), batch.column("cells"), strict=True):
                if chunk != now and now is not None:
                    yield done()
                    total[:] = 0
                now = chunk
                total += A.numbers(cells)
        if now is not None:
            yield done()

    chunks = rows.mapInArrow(add, "chunk int, cells binary").repartition("chunk").sortWithinPartitions("chunk")
    return chunks.mapInArrow(merge, "chunk int, reached binary")


def _reached(sketch: DataFrame) -> np.ndarray:
    """One bit for each cell; ROWS * WIDTH / 8 bytes come to the driver at most."""
    out = np.zeros((ROWS * WIDTH // CHUNK, CHUNK // 8), np.uint8)
    for chunk, reached in sketch.collect():
        out[chunk] = np.frombuffer(reached, np.uint8)
    return out.reshape(-1)


def counted(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, source, term, n, docs) of the terms that the sketch does not rule out, exactly; rows are (lang, source, text) without nulls."""
    shared = rows.sparkSession.sparkContext.broadcast(_reached(sketched(rows.select("lang", "text"), least)))

    @A.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (lang, langs), (source, sources) = _coded(batch.column("lang")), _coded(batch.column("source"))
            many = max(len(sources), 1)
            for group, term, docs, n, terms in _postings(batch.column("text"), lang * many + source):
                cells = _cells(langs, group // many, terms, term)
                may = (shared.value[cells >> 3] >> (7 - (cells & 7)) & 1).all(0)
                group, term = group[may], term[may]
                found = [pc.take(langs, pa.array(group // many)), pc.take(sources, pa.array(group % many)), pc.take(terms, pa.array(term)).cast(pa.binary()).cast(pa.string()), pa.array(n[may]), pa.array(docs[may])]
                yield pa.RecordBatch.from_arrays(found, names=["lang", "source", "term", "n", "docs"])

    out = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return out.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms))"""
    whole = lambda c: f"cast({c} as decimal(28,0))"
    return F.expr(f"1 + (cast(1000000000 as decimal(10,0)) * ({whole(n)} + 2)) div ({whole(total)} + 2 * {whole(terms)})")


def _far(p: str, q: str) -> str:
    """floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1, so squares stay in 64 bits."""
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div (({p}) + ({q}))"


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a language the divergence from each other one (`pair`), and its most telling terms (`term`)."""
    bounded_batches(docs.sparkSession)
    text_ = lambda c: F.coalesce(col(c).cast("string"), F.lit(""))
    rows = docs.select(text_(lang).alias("lang"), text_(source).alias("source"), text_(text).alias("text"))
    of_term = Window.partitionBy("lang", "term")
    kept = counted(rows, least).select("*", F.sum("docs").over(of_term).alias("of_lang"), F.sum("n").over(of_term).alias("all_n"), (F.min("source").over(of_term) == F.col("source")).alias("once"))
    kept = written(kept.where(F.col("of_lang") >= least).drop("docs", "of_lang"), "terms")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("once").cast("long")).alias("once"))
    groups = rows.groupBy("lang", "source").agg(F.lit(1).alias("here")).join(sums, ["lang", "source"], "left")
    langs = groups.groupBy("lang").agg(F.coalesce(F.sum("once"), F.lit(0)).alias("terms"), F.coalesce(F.sum("total"), F.lit(0)).alias("lang_total"))
    groups = written(groups.join(langs, "lang").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "terms", "lang_total"), "groups", F.count(F.lit(1)))
    small = lambda df: narrow(df, groups.stats[0])
    none = groups.withColumn("p0", F.when(F.col("terms") > 0, _share("0", "total", "terms")).otherwise(F.lit(0)))
    known = small(none.where("terms > 0"))
    shares = kept.join(known, ["lang", "source"]).withColumn("p", _share("n", "total", "terms"))

    telling = shares.withColumn("q", _share("all_n", "lang_total", "terms")).where("p > q")
    telling = telling.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_far("p", "q")).alias("value"))

    # Of a pair a < b: sum over terms of both, then what each has alone, then what neither has.
    shares = written(shares.select("lang", "term", "source", "n", "p", "p0"), "shares")
    a, b = (shares.select("lang", "term", *(F.col(c).alias(f"{side}_{c}") for c in ("source", "p", "p0"))) for side in "ab")
    both = a.join(b, ["lang", "term"]).where("a_source < b_source")
    both = both.groupBy("lang", F.col("a_source").alias("x"), F.col("b_source").alias("y")).agg(F.sum(F.expr(f"{_far('a_p', 'b_p')} - {_far('a_p', 'b_p0')} - {_far('a_p0', 'b_p')} + {_far('a_p0', 'b_p0')}")).alias("part_of_both"))
    other = lambda side, keep: none.select("lang", F.col("source").alias(side), F.col("p0").alias(f"{side}_p0"), *keep)
    counts = shares.groupBy("lang", F.col("source").alias("x"), "p", F.col("p0").alias("x_p0")).agg(F.count(F.lit(1)).alias("many"))
    alone = counts.join(small(other("y", [])), "lang").where("x <> y")
    alone = alone.groupBy("lang", "x", "y").agg(F.sum(F.expr(f"many * ({_far('p', 'y_p0')} - {_far('x_p0', 'y_p0')})")).alias("part_of_one"))
    pairs = other("x", ["terms"]).join(small(other("y", [])), "lang").where("x <> y")
    pairs = pairs.select("lang", "x", "y", F.when(F.col("terms") > 0, F.col("terms") * F.expr(_far("x_p0", "y_p0"))).otherwise(F.lit(0)).alias("neither"))
    flip = lambda df: df.unionByName(df.select("lang", F.col("y").alias("x"), F.col("x").alias("y"), *df.columns[3:]))
    one = flip(alone).groupBy("lang", "x", "y").agg(F.sum("part_of_one").alias("part_of_one"))
    value = sum((F.coalesce(F.col(c), F.lit(0)) for c in ("neither", "part_of_both", "part_of_one")), F.lit(0))
    pairs = pairs.join(flip(both), ["lang", "x", "y"], "left").join(one, ["lang", "x", "y"], "left")
    pairs = pairs.select("lang", F.col("x").alias("source"), F.lit("pair").alias("part"), F.col("y").alias("item"), value.cast("long").alias("value"))

    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best))
    out = written(ranked(pairs).unionByName(ranked(telling).where(F.col("rank") <= top)), "audit")
    dropped(kept, groups, shares)
    return out
