"""Removal of long substrings that an earlier document holds, by bucket refinement.

Every byte covered by a string of `LENGTH` bytes that also starts in a document with a smaller
id goes. Strings are told apart as in bucket-pointer refinement of suffixes: first buckets of
q-grams, then buckets are refined by the bucket identifiers at later offsets, and only buckets
that are not settled are refined further.

1. A string's first bucket is the least q-gram identifier among those inside it. It depends on
   the string alone, and neighbouring starts mostly share it, so a run of starts with one
   bucket travels as one row. Buckets with a single document are settled: nothing repeats.
2. Buckets are refined by the identity of the whole run (the bytes that its strings span).
   All strings of a run that an earlier document holds too are settled: they go. A string
   reaches at least SIDE bytes beyond its bucket's q-gram on one side, so different runs are
   settled too unless they agree on SIDE bytes before or after it.
3. Of the runs still open, the strings are told apart one by one. The bucket of q bytes at each
   place is refined by the bucket at the place q further on, which makes buckets of 2q bytes; these,
   updated, are refined by one another in turn until buckets hold strings of LENGTH bytes. A sort
   by the last buckets and documents settles them.

Bucket identifiers are hashes and not ranks, so a level of refinement needs no sort of all places:
64 bits for buckets and runs, 128 for strings. Rows are packed into one value per task and bucket. Within a
task, repeats of a run travel no further than that they go, so a passage that very many
documents share loads no bucket with more than a row per batch.

Defined cases: a null text is empty; a text under LENGTH bytes loses nothing. A row without an
id loses nothing and takes nothing from others. Rows that repeat an id are one document: they take
nothing from each other, and each loses what a smaller id holds; where their texts differ, a text is
known by its id and a hash. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspan.llm import _arrays as A
from trialspan.llm._store import bounded_batches, narrow, written

LENGTH = 50
Q = 20
SPAN = LENGTH - Q + 1
#: Bytes that a string reaches beyond the q-gram on one side or the other.
SIDE = SPAN // 2
#: Starts in a run at most.
RUN = 64
#: Bytes of text whose rows a task holds before it sends them on.
FLUSH_BYTES = 4 << 20
#: Bytes of text for each bucket of packed rows.
BUCKET_BYTES = 8 << 20
#: Shuffle partitions at most; beyond them a task goes through several buckets, one after the other.
PARTITIONS = 20_000
_U = np.uint64


def _least(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the least of SPAN consecutive values, the first place that has it), at each position."""
    low, at, width = g, np.arange(len(g), dtype=np.int32), 1

    def joined(shift: int) -> tuple[np.ndarray, np.ndarray]:
        left = low[:-shift] <= low[shift:]
        return np.where(left, low[:-shift], low[shift:]), np.where(left, at[:-shift], at[shift:])

    while 2 * width <= SPAN:
        low, at = joined(width)
        width *= 2
    return joined(SPAN - width) if width < SPAN else (low, at)


def _runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(bucket, run identity, text, first start within it, starts, side before, side after) of all runs.

    A side is a 16-bit hash of the SIDE bytes before or after the run's q-gram, 0 if no string
    of the run reaches so far, and 1 if the run has several places of its q-gram.
    """
    n = len(data) - LENGTH + 1
    none = np.empty(0, _U), np.empty(0, _U), *(np.empty(0, np.int64) for _ in range(5))
    if n <= 0:
        return none
    sums = A.prefix(data)
    at = np.arange(len(data) - Q + 1)
    low, place = _least(A.spans(sums, at, at + Q))
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[:n]
    whole = np.arange(n) + LENGTH <= off[doc + 1]
    new = np.concatenate(([True], (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])))
    first = np.flatnonzero(new)
    since = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    first = np.flatnonzero((new | (since % RUN == 0)) & whole)
    if not len(first):
        return none
    last = np.flatnonzero(np.concatenate((new[1:] | (since[1:] % RUN == 0) | ~whole[1:], [True])) & whole)
    d, gram = doc[first], place[first].astype(np.int64)

    def side(start: np.ndarray, fits: np.ndarray) -> np.ndarray:
        start = np.where(fits, start, first)
        h = (A.spans(sums, start, start + SIDE) >> _U(48)).astype(np.int64)
        return np.where(place[last] != gram, 1, np.where(fits, np.maximum(h, 2), 0))

    before = side(gram - SIDE, first <= gram - SIDE)
    after = side(gram + Q, last + LENGTH >= gram + Q + SIDE)
    return low[first], A.spans(sums, first, last + LENGTH), d, first - off[d], last - first + 1, before, after


def _planes(x: np.ndarray, k: int) -> bytes:
    """The k low bytes of each value, byte by byte: equal high bytes stand together and compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize)[:, :k].T).tobytes()


def _from_planes(raw: np.ndarray, n: int, k: int, kind: type) -> np.ndarray:
    out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    out[:, :k] = raw.reshape(k, n).T
    return out.reshape(-1).view(kind)


#: Bytes kept of bucket, identity, document, its part (0 unless an id has several texts), start, number of starts, sides.
_WIDTHS = ((8, _U), (8, _U), (8, np.int64), (8, np.int64), (4, np.int64), (1, np.int64), (2, np.int64), (2, np.int64))


def _pack(columns: tuple[np.ndarray, ...]) -> bytes:
    return A.squeezed(b"".join(_planes(np.ascontiguousarray(c), k) for c, (k, _) in zip(columns, _WIDTHS, strict=True)))


def _unpack(blobs: list[pa.Scalar]) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[] for _ in _WIDTHS]
    for blob in blobs:
        raw = np.frombuffer(A.restored(blob), np.uint8)
        n, at = len(raw) // sum(k for k, _ in _WIDTHS), 0
        for part, (k, kind) in zip(parts, _WIDTHS, strict=True):
            part.append(_from_planes(raw[at : at + n * k], n, k, kind))
            at += n * k
    return [np.concatenate(p) if p else np.empty(0, kind) for p, (_, kind) in zip(parts, _WIDTHS, strict=True)]


def _rows(groups: np.ndarray, columns: tuple[np.ndarray, ...], kind: int) -> Iterator[tuple[int, int, bytes]]:
    order = np.argsort(groups, kind="stable")
    first = np.flatnonzero(np.diff(groups[order], prepend=-1))
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
        part = order[lo:hi]
        yield int(groups[part[0]]), kind, _pack(tuple(c[part] for c in columns))


def _bucket(h: np.ndarray, many: int) -> np.ndarray:
    return ((h & _U(0xFFFFFFFF)) * _U(many) >> _U(32)).astype(np.int64)


_PACKED = "bucket int, kind int, rows binary"
_GONE = "doc long, part long, start long, starts long, open boolean"


def _packed(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "kind", "rows"])


def _settled(key: np.ndarray, identity: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by key, identity and document; number of the (key, identity) group of each; first of each group)."""
    order = np.lexsort((doc, identity, key))
    k, i = key[order], identity[order]
    new = np.concatenate(([True], (k[1:] != k[:-1]) | (i[1:] != i[:-1])))
    return order, np.cumsum(new) - 1, np.flatnonzero(new)


def _first_runs(many: int):
    def sent(found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        columns = tuple(np.concatenate(c) for c in zip(*found, strict=True))
        low, same, doc = columns[:3]
        if len(low):
            order, group, first = _settled(low, same, doc)
            gone = doc[order] > doc[order][first][group]  # an earlier document of this task has the run
            kept, lost = np.sort(order[~gone]), np.sort(order[gone])
            out = list(_rows(_bucket(low[kept], many), tuple(c[kept] for c in columns), 0))
            if len(lost):
                out += _rows(np.abs(doc[lost]) % many, tuple(c[lost] for c in columns), 1)
            yield _packed(out)

    @A.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            ids, parts = batch.column("id").to_numpy(), batch.column("part").to_numpy()
            for i, _, off, data in A.slices(batch.column("text")):
                low, same, d, *rest = _runs(data, off)
                found.append((low, same, ids[i + d], parts[i + d], *rest))
                held += len(data)
                if held > FLUSH_BYTES:
                    yield from sent(found)
                    found, held = [], 0
        if found:
            yield from sent(found)

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """(packed rows of kind 0, of kind 1) of each bucket, from batches in the order of buckets."""
    now, held = None, ([], [])
    for batch in batches:
        for b, kind, rows in zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist(), batch.column("rows"), strict=True):
            if b != now and now is not None:
                yield held
                held = ([], [])
            now = b
            held[kind].append(rows)
    if now is not None:
        yield held


def _gone(doc: np.ndarray, part: np.ndarray, start: np.ndarray, starts: np.ndarray, open_: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*map(pa.array, (doc, part, start, starts)), pa.array(np.full(len(doc), open_))], names=["doc", "part", "start", "starts", "open"])


@A.lean
def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs that go, and runs of first holders whose strings are to be told apart."""
    for rows, lost in _grouped(batches):
        if lost:
            yield _gone(*_unpack(lost)[2:6], False)
        if not rows:
            continue
        low, same, doc, part, start, starts, before, after = _unpack(rows)
        order, group, first = _settled(low, same, doc)
        low, doc, part, start, starts = low[order], doc[order], part[order], start[order], starts[order]
        gone = doc > doc[first][group]
        yield _gone(doc[gone], part[gone], start[gone], starts[gone], False)
        edge = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        many = np.diff(np.append(edge, len(low)))
        spread = np.repeat(np.minimum.reduceat(doc, edge) != np.maximum.reduceat(doc, edge), many)[first]
        key, sides = low[first], (before[order][first], after[order][first])
        open_ = _shared(key[spread], *(x[spread] for x in sides))
        still = np.zeros(len(first), bool)
        still[np.flatnonzero(spread)[open_]] = True
        still = still[group] & ~gone
        yield _gone(doc[still], part[still], start[still], starts[still], True)


def _shared(key: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Whether another run of the bucket agrees on a side; all of a bucket with a run that has several places."""
    out = np.zeros(len(key), bool)
    for side in (before, after):
        order = np.lexsort((side, key))
        k, s = key[order], side[order]
        equal = (k[1:] == k[:-1]) & (s[1:] == s[:-1]) & (s[1:] != 0)
        out[order[1:][equal]] = True
        out[order[:-1][equal]] = True
    wild = np.unique(key[before == 1])
    if len(wild):
        out |= wild[np.minimum(np.searchsorted(wild, key), len(wild) - 1)] == key
    return out


def _buckets(sums: np.ndarray, lo: int, hi: int) -> list[np.ndarray]:
    """Two identifiers of the bucket of each string of LENGTH bytes that starts in [lo, hi): q-grams, refined by the refined buckets at later offsets."""
    at = np.arange(lo, hi + LENGTH - Q)
    grams = A.spans(sums, at, at + Q)
    out = []
    for lane in (0, 2):
        ids, length = grams, Q
        while length < LENGTH:
            step = min(length, LENGTH - length)
            ids = A.mix(ids[:-step] * A._LANES[lane] + ids[step:] * A._LANES[lane + 1])
            length += step
        out.append(ids)
    return out


def _strings(many: int):
    """One row for each string in the runs of (id, part, text, runs)."""

    def sent(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, other, doc, part, start = (np.concatenate(c) for c in zip(*parts, strict=True))
        one, zero = np.ones(len(key), np.int64), np.zeros(len(key), np.int64)
        return _packed(list(_rows(_bucket(key, many), (key, other, doc, part, start, one, zero, zero), 0)))

    @A.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            ids, own, runs = batch.column("id").to_numpy(), batch.column("part").to_numpy(), batch.column("runs")
            for i, j, off, data in A.slices(batch.column("text")):
                sums = A.prefix(data)
                for k in range(i, j):
                    s = _starts(runs[k])
                    lo = int(s.min()) + int(off[k - i])
                    key, other = (x[s + off[k - i] - lo] for x in _buckets(sums, lo, int(s.max()) + int(off[k - i]) + 1))
                    parts.append((key, other, np.full(len(s), ids[k]), np.full(len(s), own[k]), s))
                    held += len(s)
                if held > FLUSH_BYTES // 16:
                    yield sent(parts)
                    parts, held = [], 0
        if parts:
            yield sent(parts)

    return run


def _starts(runs: pa.Scalar) -> np.ndarray:
    """All starts in a list of (start, starts)."""
    flat = runs.values
    first, n = flat.field(0).to_numpy(), flat.field(1).to_numpy()
    return np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))


@A.lean
def _told_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, _ in _grouped(batches):
        key, other, doc, part, start = _unpack(rows)[:5]
        order, group, first = _settled(key, other, doc)
        gone = doc[order] > doc[order][first][group]
        doc, part, start = doc[order][gone], part[order][gone], start[order][gone]
        order = np.lexsort((start, part, doc))  # starts in a row become one run
        doc, part, start = doc[order], part[order], start[order]
        if len(doc):
            edge = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (part[1:] != part[:-1]) | (start[1:] != start[:-1] + 1))))
            yield _gone(doc[edge], part[edge], start[edge], np.diff(np.append(edge, len(doc))), False)


@A.lean
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, runs = [batch.column("id"), batch.column("part")], batch.column("runs")
        removed, spans, digests = [], [], []
        for i, j, off, data in A.slices(batch.column("text")):
            for k in range(i, j):
                text = data[off[k - i] : off[k - i + 1]]
                change = np.zeros(len(text) + 1, np.int64)
                flat = runs[k].values
                first, n = flat.field(0).to_numpy(), flat.field(1).to_numpy()
                np.add.at(change, first, 1)
                np.add.at(change, first + n + LENGTH - 1, -1)
                out = np.cumsum(change)[:-1] > 0
                removed.append(int(out.sum()))
                spans.append(int((np.diff(out.astype(np.int8), prepend=0) == 1).sum()))
                digests.append(hashlib.sha256(text[~out].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([*ids, pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())], names=["id", "part", "n_removed", "n_spans", "digest"])


def _with_runs(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """(id, part, text, runs) of the texts that have runs; few enough ids narrow the texts before they are shuffled."""
    lists = written(runs.groupBy("doc", "part").agg(F.collect_list(F.struct("start", "starts")).alias("runs")), "runs").withColumnRenamed("doc", "id")
    rows = rows.join(narrow(lists.select("id").distinct()), "id", "left_semi")
    return rows.dropDuplicates(["id", "part"]).hint("merge").join(lists, ["id", "part"]).select("id", "part", "text", "runs")


def _parted(rows: DataFrame) -> DataFrame:
    """rows with `part`: 0, but a hash of the text where an id has several texts."""
    own = F.xxhash64("text")
    several = written(rows.groupBy("id").agg(F.min(own).alias("low"), F.max(own).alias("high")).where("low <> high").select("id", F.lit(True).alias("several")), "several", F.count(F.lit(1)))
    if not several.stats[0]:
        return rows.withColumn("part", F.lit(0).cast("long"))
    return rows.join(narrow(several, several.stats[0]), "id", "left").withColumn("part", F.when(F.col("several"), own).otherwise(F.lit(0))).drop("several")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row."""
    bounded_batches(docs.sparkSession)
    every = _parted(docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    rows = every.where(F.col("id").isNotNull() & (F.octet_length("text") >= LENGTH))
    many = max(4, int((rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0) / BUCKET_BYTES))

    def by_bucket(df: DataFrame) -> DataFrame:
        return df.repartition(min(many, PARTITIONS), "bucket").sortWithinPartitions("bucket")

    found = written(by_bucket(rows.mapInArrow(_first_runs(many), _PACKED)).mapInArrow(_refined, _GONE), "runs")
    open_ = _with_runs(rows, found.where("open"))
    strings = written(by_bucket(open_.mapInArrow(_strings(many), _PACKED)).mapInArrow(_told_apart, _GONE), "strings")
    cut = _with_runs(rows, found.where("not open").unionByName(strings)).mapInArrow(_cut, "id long, part long, n_removed long, n_spans long, digest string")
    out = every.select("id", "part", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole")).join(cut, ["id", "part"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(F.col("id").alias(doc_id), "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("digest", "whole").alias("kept_sha256"))
