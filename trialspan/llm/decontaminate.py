"""Benchmark decontamination by the q-gram lemma and banded alignment.

Benchmark items are cut into overlapping windows (an item no longer than a window is one). A
region of a text within e edits of a window of m bytes shares at least m - q + 1 - q*e q-grams
with it, on diagonals that lie within e + 1 of each other. So q-grams of every text are looked
up, shared ones are counted per window in overlapping bands of diagonals, bands under the bound
are dropped, and the rest is verified by an alignment limited to the band. Nothing else is
compared, and no true region is lost.

Texts and items are compared as bytes with A-Z lower-cased and every blank byte read as a space.
The benchmark is sent to the workers in blocks of bounded size; a larger benchmark takes more
passes over the texts and not more memory.

Defined cases: null and empty texts match nothing; null items and items shorter than q bytes,
which chance would find, are not searched. Repeated rows are each judged. An empty benchmark or table gives an empty result.
Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspan.llm import _arrays as A
from trialspan.llm._store import bounded_batches

Q = 16
#: (bytes of a window, bytes between windows, bytes for each edit that is allowed): long ones with more edits, and short ones close together, so that an unchanged quotation of 87 bytes holds a whole window.
WINDOWS = [(100, 50, 20), (80, 8, 25)]
#: Bytes of benchmark that are searched in one pass over the texts.
BLOCK_BYTES = 4 << 20
#: Shared q-grams that are counted at once.
CHUNK = 1 << 20
_REACH = 512
_FOLD = A.LOWER.copy()
_FOLD[~A.IS_WORD] = 0x20
_MARK_BITS = 22
_U = np.uint64


def _qgrams(data: np.ndarray) -> np.ndarray:
    n = len(data) - Q + 1
    if n <= 0:
        return np.empty(0, _U)
    at = np.arange(n)
    return A.spans(A.prefix(data), at, at + Q)


def _added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Counts of equal (text, window, band) added up."""
    doc, window, band, n = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 4
    if not len(doc):
        return doc, window, band, n
    order = np.lexsort((band, window, doc))
    doc, window, band, n = doc[order], window[order], band[order], n[order]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(doc) != 0) | (np.diff(window) != 0) | (np.diff(band) != 0))))
    return doc[new], window[new], band[new], np.add.reduceat(n, new)


def _outside_repeats(g: np.ndarray, off: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """False for places far inside a run of equal q-grams at a period of up to Q bytes.

    What lies around such a place is repeated, byte for byte, nearer to the ends of the run, and
    no region reaches that far, so the same windows are found there.
    """
    drop = np.zeros(len(g), bool)
    doc = np.searchsorted(off, np.arange(len(g)), "right")
    for period in range(1, min(Q, len(g) - 1) + 1):
        same = (g[:-period] == g[period:]) & (doc[:-period] == doc[period:])
        change = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).astype(np.int8)))
        first, last = change[::2], change[1::2]
        for a, b in zip(first[last - first > 2 * _REACH].tolist(), last[last - first > 2 * _REACH].tolist(), strict=True):
            drop[a + _REACH : b - _REACH] = True
    return ~drop[pos]


class Index:
    """The q-grams of some items by their places, and the windows that cover a place."""

    def __init__(self, items: list[tuple[int, str]]):
        folded = [(item, _FOLD[np.frombuffer((text or "").encode(), np.uint8)]) for item, text in items]
        folded = [(item, data) for item, data in folded if len(data) >= Q]
        self.data = np.concatenate([d for _, d in folded]) if folded else np.empty(0, np.uint8)
        off = np.concatenate(([0], np.cumsum([len(d) for _, d in folded]))).astype(np.int64)
        start, size, edits, item, self.families = [], [], [], [], []
        for length, step, share in WINDOWS:
            first = len(start)
            for (name, data), at in zip(folded, off[:-1].tolist(), strict=True):
                last = max(0, len(data) - length)
                for s in sorted({*range(0, last + 1, step), last}):
                    m = min(length, len(data))
                    start.append(at + s), size.append(m), item.append(name)
                    edits.append(min(m // share, max((m - Q) // Q, 0)))
            self.families.append((length, first, np.array(start[first:], np.int64)))
        self.start, self.size, self.edits, self.item = (np.array(x, np.int64) for x in (start, size, edits, item))
        self.least = self.size - Q + 1 - Q * self.edits
        g = _qgrams(self.data)
        place = np.arange(len(g))
        place = place[place + Q <= off[np.searchsorted(off, place, "right")]] if len(g) else place
        order = np.argsort(g[place], kind="stable")
        self.place = place[order].astype(np.int32)
        self.keys, first = np.unique(g[place][order], return_index=True)
        self.first = np.append(first, len(place))
        self.mark = np.zeros(1 << _MARK_BITS, bool)
        self.mark[(self.keys >> _U(64 - _MARK_BITS)).astype(np.int64)] = True

    def search(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, window, diagonal) of verified regions in folded texts."""
        g = _qgrams(data)
        none = np.empty(0, np.int64)
        pos = np.flatnonzero(self.mark[(g >> _U(64 - _MARK_BITS)).astype(np.int64)]) if len(self.keys) else none
        if not len(pos):
            return none, none, none
        key = np.minimum(np.searchsorted(self.keys, g[pos]), len(self.keys) - 1)
        doc = np.searchsorted(off, pos, "right") - 1
        good = (self.keys[key] == g[pos]) & (pos + Q <= off[doc + 1])
        pos, key, doc = pos[good], key[good], doc[good]
        many = self.first[key + 1] - self.first[key]
        if int(many.sum()) > CHUNK:
            good = _outside_repeats(g, off, pos)
            pos, key, doc, many = pos[good], key[good], doc[good], many[good]
        ends = np.cumsum(many)
        total = int(ends[-1]) if len(ends) else 0
        open_: list[tuple[np.ndarray, ...]] = []
        found: list[tuple[np.ndarray, ...]] = []
        for lo in range(0, total, CHUNK):
            pair = np.arange(lo, min(lo + CHUNK, total))
            hit = np.searchsorted(ends, pair, "right")
            place = self.place[self.first[key[hit]] + pair - (ends[hit] - many[hit])].astype(np.int64)
            here = doc[hit]
            open_ = [_added([*open_, *self._bands(pos[hit] - off[here], here, place)])]
            rows = open_[0]
            if pair[-1] + 1 < total:  # bands that later q-grams can still add to stay open
                at = hit[-1]
                passed = (rows[0] < doc[at]) | (rows[2] * (self.edits[rows[1]] + 1) - _REACH + self.size[rows[1]] + 4 * (self.edits[rows[1]] + 1) < pos[at] - off[doc[at]])
                open_ = [tuple(x[~passed] for x in rows)]
                rows = tuple(x[passed] for x in rows)
            found.append(self._regions(data, off, *rows))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none, none)

    def _regions(self, data: np.ndarray, off: np.ndarray, doc: np.ndarray, window: np.ndarray, band: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, window, diagonal) of the bands that reach their bound and are verified."""
        good = count >= self.least[window]
        doc, window, band = doc[good], window[good], band[good]
        low = band * (self.edits[window] + 1) - _REACH
        good = self._verified(data, off, doc, window, low)
        return doc[good], window[good], low[good]

    def _bands(self, pos: np.ndarray, doc: np.ndarray, place: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """(text, window, band of diagonals, shared q-grams) of q-grams that stand at a position of a text and at a place of the benchmark.

        Q-grams in a row on one diagonal are one stretch, so a stretch and a window meet once, with
        as many q-grams as both cover; the rows of a chunk are made in parts of bounded size.
        """
        order = np.lexsort((pos, place - pos, doc))
        pos, doc, place = pos[order], doc[order], place[order]
        new = np.flatnonzero(np.concatenate(([True], (np.diff(doc) != 0) | (np.diff(pos) != 1) | (np.diff(place) != 1))))
        first, length = place[new], np.diff(np.append(new, len(place)))
        doc, shift = doc[new], pos[new] - first
        out: list[tuple[np.ndarray, ...]] = []
        for size, start_at, start in self.families:
            lo, hi = np.searchsorted(start, first - size + Q), np.searchsorted(start, first + length - 1, "right")
            n = hi - lo
            ends = np.cumsum(n)
            for part in np.split(np.arange(len(n)), np.unique(np.searchsorted(ends, np.arange(CHUNK, int(ends[-1]), CHUNK)))):
                k = n[part]
                at = np.repeat(part, k)
                window = np.repeat(lo[part] - (np.cumsum(k) - k), k) + np.arange(int(k.sum())) + start_at
                begin = self.start[window]
                shared = np.minimum(first[at] + length[at], begin + self.size[window] - Q + 1) - np.maximum(first[at], begin)
                at, window, begin, shared = (x[shared > 0] for x in (at, window, begin, shared))
                band = (shift[at] + begin + _REACH) // (self.edits[window] + 1)
                out.append(_added([(doc[at], window, band, shared), (doc[at], window, band - 1, shared)]))
        return out

    def _verified(self, data: np.ndarray, off: np.ndarray, doc: np.ndarray, window: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Whether the window aligns within its edits, on diagonals of the band and as many more on both sides."""
        out = np.zeros(len(doc), bool)
        kind = self.size[window] << 16 | self.edits[window]
        for m in np.unique(kind):
            which = np.flatnonzero(kind == m)
            for part in np.array_split(which, len(which) // 2048 + 1):
                if len(part):
                    out[part] = self._aligned(data, off, doc[part], window[part], low[part], int(m >> 16))
        return out

    def _aligned(self, data: np.ndarray, off: np.ndarray, doc: np.ndarray, window: np.ndarray, low: np.ndarray, m: int) -> np.ndarray:
        e = int(self.edits[window[0]])
        wide = 2 * (e + 1) + 2 * e
        texts = self.data[self.start[window][:, None] + np.arange(m)[None, :]]
        j = (off[doc] + low - e)[:, None] + np.arange(m + wide)[None, :]
        inside = (j >= off[doc][:, None]) & (j < off[doc + 1][:, None])
        region = np.where(inside, data[np.clip(j, 0, len(data) - 1)], 0)
        ramp = np.arange(wide, dtype=np.int16)
        still = np.arange(len(doc))  # alignments that are within their edits so far
        cost = np.zeros((len(doc), wide), np.int16)
        for i in range(m):
            across = cost + (region[:, i : i + wide] != texts[:, i : i + 1])
            skipped = np.full_like(cost, m)
            skipped[:, :-1] = cost[:, 1:] + 1
            cost = np.minimum.accumulate(np.minimum(across, skipped) - ramp, axis=1) + ramp
            if i % 16 == 15:
                good = cost.min(1) <= e
                if not good.all():
                    still, cost, region, texts = still[good], cost[good], region[good], texts[good]
        out = np.zeros(len(doc), bool)
        out[still] = cost.min(1) <= e
        return out


def _blocks(benchmark: DataFrame) -> list[Index]:
    """The benchmark in blocks of about BLOCK_BYTES; one block is in the driver's memory for each."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and item_id is not null")
    total = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n = int(total // BLOCK_BYTES) + 1
    for k in range(n if total else 0):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).toArrow()
        yield Index(list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, first_byte, contaminated): a row for each document and item found in it."""
    spark = docs.sparkSession
    bounded_batches(spark)
    schema = docs.select("doc_id").schema.add("item_id", "long").add("n_windows", "long").add("first_byte", "long").add("contaminated", "boolean")

    def searched(index: Index) -> DataFrame:
        shared = spark.sparkContext.broadcast(index)

        @A.lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, items, counts, firsts = [], [], [], []
                for i, _, off, data in A.slices(batch.column("text")):
                    found: dict[tuple[int, int], tuple[set[int], int]] = {}
                    for d, w, low in zip(*(x.tolist() for x in shared.value.search(_FOLD[data], off)), strict=True):
                        seen, first = found.get((i + d, shared.value.item[w]), (set(), low))
                        found[i + d, shared.value.item[w]] = (seen | {w}, min(first, max(low, 0)))
                    for (row, item), (seen, first) in found.items():
                        rows.append(row), items.append(item), counts.append(len(seen)), firsts.append(max(first, 0))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(items, pa.int64()), pa.array(counts, pa.int64()), pa.array(firsts, pa.int64()), pa.array([True] * len(rows), pa.bool_())], names=[f.name for f in schema])

        return docs.select("doc_id", "text").mapInArrow(run, schema)

    found = [searched(index) for index in _blocks(benchmark)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, all columns, without the rows whose text holds a window of the benchmark."""
    bounded_batches(docs.sparkSession)
    columns = docs.columns
    at = [c.lower() for c in columns].index("text")
    docs = docs.toDF(*(f"c{k}" for k in range(len(columns))))  # Arrow functions take no dotted names
    for index in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        @A.lean
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(len(batch), bool)
                for i, _, off, data in A.slices(batch.column(at)):
                    keep[i + shared.value.search(_FOLD[data], off)[0]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs.toDF(*columns)
