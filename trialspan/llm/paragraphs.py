"""Repeated passages across documents by paragraph MinHash banding.

A paragraph is a line, or a run of lines of fewer than `LEAST` words each, and each piece of it
cut where the hash of three words is the least among its neighbours in it. Such cuts depend on a
few words around them and never on other lines, so equal lines have the same paragraphs, and a
passage pasted anywhere into another text has the same paragraphs inside. A line or first piece of
fewer than `LEAST` words makes a paragraph with what stands beside it, so every word of a text of
as many words is in one. Paragraphs may overlap. Equal paragraphs are one class by their hash.
Different ones are sketched by minimum hashes of their five-word shingles; those that collide
in a band are compared on their full shingle sets, and pairs of Jaccard similarity of at least
80 percent are links. Components of links are clusters. In a cluster that spans several
documents the paragraphs of the smallest document id stay and all others go.

A key of more than `HOT` different paragraphs is not compared in one task. Its sets are compared
with the first of them; what is then in several parts is dealt by the rarest shingles of each set,
of which two sets that are alike must share one, and so on to cells of a bounded number of sets.

Bands are tuned for recall: six of two rows miss a pair at 0.8 with probability 0.002, one at
0.9 with 5e-5, and equal ones never. Rows are packed by task and bucket; repeats within a task are
merged before the shuffle. Keys of several bands that hold the same classes are compared once. Identifiers of words, shingles and classes are 64-bit hashes.

Defined cases: a null or empty text, or one of fewer than `LEAST` words, has no paragraphs. A row without an id takes no part. Rows that repeat an id are one document. An
empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialspan.llm import _arrays as A
from trialspan.llm._components import components
from trialspan.llm._store import bounded_batches, narrow, written

SHINGLE = 5
#: Words of the least paragraph, and the words on each side among which a cut is the least.
LEAST, REACH = 7, 6
BANDS, ROWS = 6, 2
PERCENT = 80
#: Bytes of text for each bucket of packed rows.
BUCKET_BYTES = 8 << 20
#: Shuffle partitions at most; beyond them a task goes through several buckets, one after the other.
PARTITIONS = 20_000
#: Different paragraphs of one key that a task compares with each other; those of larger keys are dealt to several.
HOT = 2_000
#: Bytes of text whose rows a task holds before it sends them on.
FLUSH_BYTES = 4 << 20
#: Words of the sets that a task makes at once, and one set alone if it has more.
SENT_WORDS = 1 << 20
_MIN = np.random.default_rng(17).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_U = np.uint64
_TOP = np.iinfo(np.uint64).max
#: Bits of a band's key that are kept; what they confuse is told apart on full sets.
_KEY = _U((1 << 40) - 1)
_LOW = (1 << 32) - 1


def _around(x: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of the `reach` values before, and after, each position."""
    padded = np.concatenate((np.full(reach, _TOP), x, np.full(reach, _TOP)))
    n = len(x)
    before, after = padded[:n], padded[reach + 1 : reach + 1 + n]
    for k in range(1, reach):
        before = np.minimum(before, padded[k : k + n])
        after = np.minimum(after, padded[reach + 1 + k : reach + 1 + k + n])
    return before, after


def _segments(of: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """First words of the segments of texts: lines, where consecutive ones under LEAST words are one."""
    line = np.flatnonzero(np.concatenate(([True], (lines[1:] != lines[:-1]) | (of[1:] != of[:-1]))))
    short = np.diff(np.append(line, len(of))) < LEAST
    goes_on = np.concatenate(([False], short[1:] & short[:-1] & (of[line[1:]] == of[line[:-1]])))
    return line[~goes_on]


def _units(s: np.ndarray, seg: np.ndarray, whole: np.ndarray, inside: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, words) of the paragraphs, from the first words of pieces and the segments they lie in.

    They are the whole segments, their pieces, a first piece under LEAST words with the next one, and
    segments under LEAST words with the nearest paragraph before and after them in their text.
    """
    size = np.diff(np.append(s, len(of)))
    e, end = s + size, (seg + whole)[inside[s]]
    head = np.flatnonzero((s == seg[inside[s]]) & (e < end) & (size < LEAST))
    begins = np.searchsorted(s, seg)
    ends = np.append(begins[1:], len(s)) - 1
    first, last = e[begins], s[ends]  # where the first paragraph of a segment ends, and its last one begins
    first = np.where((first - seg < LEAST) & (ends > begins), e[np.minimum(begins + 1, ends)], first)
    last = np.where((seg + whole - last < LEAST) & (ends > begins), s[np.maximum(ends - 1, begins)], last)
    few = whole < LEAST
    same = of[seg[1:]] == of[seg[:-1]]
    on, back = np.flatnonzero(few[:-1] & same), np.flatnonzero(few[1:] & same) + 1
    start = np.concatenate((s, seg, s[head], seg[on], last[back - 1]))
    stop = np.concatenate((e, seg + whole, e[head + 1], first[on + 1], (seg + whole)[back]))
    both = np.unique((start << 32 | stop - start)[stop - start >= LEAST])
    return both >> 32, both & _LOW


def _names(h: np.ndarray, s: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The classes of runs of words, from the words' hashes."""
    power, inverse = A._power_tables(len(h) + 1)
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(h * power[: len(h)], dtype=_U)))
    return A.mix((sums[s + size] - sums[s]) * inverse[s] + size.astype(_U) * _U(0xA24BAED4963EE407))


def paragraphs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word within it, words, class, shingle hashes with one more at the end) of the paragraphs of folded texts; the shingles of paragraph k start at its first word's place, the last column of first places."""
    starts, ends, first = A.words(data, off)
    none = np.empty(0, np.int64)
    if not len(starts):
        return none, none, none, np.empty(0, _U), np.empty(0, _U)
    h = A.spans(A.prefix(data), starts, ends)
    n = len(h)
    of = A.of_rows(first)
    lines = np.concatenate(([0], np.cumsum(data == 10)))[starts]
    seg = _segments(of, lines)
    size = np.diff(np.append(seg, n))
    inside = np.repeat(np.arange(len(seg)), size)
    three = np.concatenate((A.grams(h, 3), np.full(min(2, n), _TOP)))[:n]
    three[np.arange(n) + 2 >= (seg + size)[inside]] = _TOP
    place = np.arange(n) + REACH * inside  # segments are kept apart, so a cut depends on its own segment only
    apart = np.full(place[-1] + 1, _TOP)
    apart[place] = three
    before, after = (x[place] for x in _around(apart, REACH))
    cut = (three < before) & (three <= after) & (three != _TOP)
    cut[seg] = True
    s, size = _units(np.flatnonzero(cut), seg, size, inside, of)
    name = _names(h, s, size)
    shingles = np.concatenate((A.grams(h, SHINGLE), np.full(min(SHINGLE, n), _TOP)))
    text = of[s]
    return text, s - first[text], size, name, np.concatenate((shingles, s.astype(_U)))


def _bands(shingles: np.ndarray, s: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A key for each paragraph and band."""
    where = np.stack((s, s + size - SHINGLE + 1), 1).ravel()
    out = np.empty((len(s), BANDS), _U)
    for b in range(BANDS):
        key = np.full(len(s), _U(b))
        for r in range(ROWS):
            key += np.minimum.reduceat(A.mix(shingles ^ _MIN[b * ROWS + r]), where)[::2] * A._LANES[r]
        out[:, b] = A.mix(key) & _KEY
    return out


def _repeats(shingles: np.ndarray, s: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each paragraph holds a shingle twice, by the shingles' upper bits: what they confuse is compared in vain and no more."""
    mask = _U((1 << len(shingles).bit_length()) - 1)
    code = np.sort(shingles & ~mask | np.arange(len(shingles), dtype=_U))
    same = code[1:] ^ code[:-1] <= mask
    last = np.full(len(shingles), -1)
    last[code[1:][same] & mask] = code[:-1][same] & mask
    return np.maximum.reduceat(last, np.stack((s, s + size - SHINGLE + 1), 1).ravel())[::2] >= s


#: again: an earlier document of the task has the class too; with a band's key, that the paragraph holds a shingle twice.
_PACKED = "bucket int, kind int, rows binary"
_FIELDS = np.dtype([("key", "<u8"), ("name", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("size", "<i4"), ("again", "?")])
#: kind 0: members of classes that repeat; kind 1: paragraphs whose band another class of a like size shares, under a key for the classes that share it; kind 2: members of classes that repeat in one document only; kind 3: as 1, of keys with many.
_FOUND = "kind int, key long, name long, doc long, start int, size int"


def _several(ordered: np.ndarray) -> np.ndarray:
    """Whether each of some ordered values occurs more than once."""
    same = ordered[1:] == ordered[:-1]
    return np.concatenate(([False], same)) | np.concatenate((same, [False]))


def _planes(rows: np.ndarray) -> bytes:
    return np.ascontiguousarray(rows.view(np.uint8).reshape(-1, _FIELDS.itemsize).T).tobytes()


def _unplanes(blobs: list[pa.Scalar]) -> np.ndarray:
    parts = [np.ascontiguousarray(np.frombuffer(b.as_buffer(), np.uint8).reshape(_FIELDS.itemsize, -1).T).reshape(-1).view(_FIELDS) for b in blobs]
    return np.concatenate(parts) if parts else np.empty(0, _FIELDS)


def _dealt(rows: np.ndarray, many: int, kind: int, by: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    group = ((by & _U(0xFFFFFFFF)) * _U(many) >> _U(32)).astype(np.int64)
    order = np.argsort(group.astype(np.min_scalar_type(many)), kind="stable")
    first = _firsts(group[order])
    rows = rows[order]
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
        yield int(group[order[lo]]), kind, _planes(rows[lo:hi])


def _made(many: int):
    def sent(units: list[np.ndarray], bands: list[np.ndarray]) -> pa.RecordBatch:
        unit, keys = np.concatenate(units), np.concatenate(bands)
        units.clear(), bands.clear()
        name = np.ascontiguousarray(unit["name"])
        order = np.argsort(name)
        several = _several(name[order])
        more = order[several]
        order[several] = more[np.lexsort((unit["start"][more], unit["doc"][more], name[more]))]
        unit, keys = unit[order], keys[order]
        twice = unit["again"].copy()
        new = np.concatenate(([True], unit["name"][1:] != unit["name"][:-1]))
        group, first = np.cumsum(new) - 1, np.flatnonzero(new)
        lost = unit["doc"] > unit["doc"][first][group]  # an earlier document of this task has it
        unit["again"] = np.logical_or.reduceat(lost, first)[group]
        out = list(_dealt(unit[~lost], many, 0, unit["name"][~lost]))
        if lost.any():
            out += _dealt(unit[lost], many, 2, A.mix(unit["doc"][lost].astype(_U)))
        rows = unit[first]
        rows["again"] = twice[first]
        for b in range(BANDS):
            rows["key"] = key = keys[first, b]
            out += _dealt(rows, many, 1, key)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary())], names=["bucket", "kind", "rows"])

    @A.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, bands, held = [], [], 0
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for i, _, off, data in A.slices(batch.column("text")):
                text, start, size, name, rest = paragraphs(A.LOWER[data], off)
                if not len(text):
                    continue
                shingles, s = rest[: -len(text)], rest[-len(text) :].astype(np.int64)
                unit = np.zeros(len(text), _FIELDS)
                unit["name"], unit["doc"], unit["start"], unit["size"] = name, ids[i + text], start, size
                unit["again"] = _repeats(shingles, s, size)
                units.append(unit)
                bands.append(_bands(shingles, s, size))
                held += len(data)
                if held > FLUSH_BYTES:
                    yield sent(units, bands)
                    units, bands, held = [], [], 0
        if units:
            yield sent(units, bands)

    return run


def _found(rows: np.ndarray, kind: int) -> pa.RecordBatch:
    signed = lambda c: pa.array(np.ascontiguousarray(rows[c]).view(np.int64))
    whole = lambda c: pa.array(np.ascontiguousarray(rows[c]))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), kind, np.int32)), signed("key"), signed("name"), whole("doc"), whole("start"), whole("size")], names=["kind", "key", "name", "doc", "start", "size"])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, list]]:
    now, held = None, {}
    for batch in batches:
        for b, kind, rows in zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist(), batch.column("rows"), strict=True):
            if b != now and now is not None:
                yield held
                held = {}
            now = b
            held.setdefault(kind, []).append(rows)
    if now is not None:
        yield held


def _alike(rows: np.ndarray, first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Places of rows that another of their key may be linked with, by the sizes of the sets; where a shingle repeats, sizes say nothing."""
    group = np.repeat(np.arange(len(first)), many)
    order = np.lexsort((rows["size"], group))
    size = rows["size"][order].astype(np.int64) - SHINGLE + 1
    near = (group[1:] == group[:-1]) & (100 * size[:-1] >= PERCENT * size[1:])
    keep = np.concatenate(([False], near)) | np.concatenate((near, [False]))
    keep |= (np.logical_or.reduceat(rows["again"], first) & (many > 1))[group]
    return order[keep]


def _firsts(ordered: np.ndarray) -> np.ndarray:
    """Places where another value begins."""
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))[: len(ordered)])


def _sets_of(names: np.ndarray, first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """A key for the different classes of each key, the same for keys, of any band, that hold the same ones: their links are the same."""
    return A.mix(np.add.reduceat(A.mix(names), first) + many.astype(_U)) if len(first) else np.empty(0, _U)


def _collided(hot: int):
    @A.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _grouped(batches):
            if 2 in held:
                yield _found(_unplanes(held[2]), 0)
            if 0 in held:
                rows = _unplanes(held[0])
                name = np.ascontiguousarray(rows["name"])
                order = np.argsort(name, kind="stable")
                rows = rows[order[_several(name[order]) | rows["again"][order]]]
                first = _firsts(rows["name"])
                many = np.diff(np.append(first, len(rows)))
                if len(rows):
                    spread = (np.minimum.reduceat(rows["doc"], first) != np.maximum.reduceat(rows["doc"], first)) | np.logical_or.reduceat(rows["again"], first)
                    yield _found(rows[np.repeat(spread, many)], 0)
                    yield _found(rows[np.repeat(~spread, many)], 2)
            if 1 in held:
                rows = _unplanes(held[1])
                key = np.ascontiguousarray(rows["key"])
                order = np.argsort(key)
                rows = rows[order[_several(key[order])]]
                rows = rows[np.lexsort([np.ascontiguousarray(rows[c]) for c in ("start", "doc", "name", "key")])]
                rows = rows[np.concatenate(([True], (rows["key"][1:] != rows["key"][:-1]) | (rows["name"][1:] != rows["name"][:-1])))[: len(rows)]]
                first = _firsts(rows["key"])
                rows = rows[_alike(rows, first, np.diff(np.append(first, len(rows))))] if len(rows) else rows
                first = _firsts(rows["key"])
                many = np.diff(np.append(first, len(rows)))
                rows["key"] = np.repeat(_sets_of(rows["name"], first, many), many)
                large = np.repeat(many > hot, many)
                yield _found(rows[~large], 1)
                if large.any():
                    yield _found(rows[large], 3)

    return run


@A.lean
def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, name, shingles) of the wanted paragraphs of each text."""
    for batch in batches:
        wanted = batch.column("wanted")
        for i, j, off, data in A.slices(batch.column("text")):
            data = A.LOWER[data]
            starts, ends, first = A.words(data, off)
            lists = wanted.slice(i, j - i)
            rows, of = lists.flatten(), np.repeat(np.arange(j - i), lists.value_lengths().to_numpy())
            s, size = first[of] + rows.field("start").to_numpy(), rows.field("size").to_numpy().astype(np.int64)
            here = np.flatnonzero(s + size <= first[of + 1])  # another text of the same id may hold the others
            if not len(here):
                continue
            h = A.spans(A.prefix(data), starts, ends)
            here = here[_names(h, s[here], size[here]).view(np.int64) == rows.field("name").to_numpy()[here]]
            here = here[np.argsort(s[here] << 32 | size[here])]
            values, rank = np.unique(A.grams(h, SHINGLE), return_inverse=True)
            for part in np.split(here, np.flatnonzero(np.diff(np.cumsum(size[here]) // SENT_WORDS)) + 1):
                place, which = np.unique(s[part] << 32 | size[part], return_inverse=True)
                sets = _sets(values, rank, place >> 32, (place & _LOW) - SHINGLE + 1)
                at = pa.array(part)
                yield pa.RecordBatch.from_arrays([rows.field("key").take(at), rows.field("name").take(at), sets.take(pa.array(which))], names=["key", "name", "shingles"])


def _sets(values: np.ndarray, rank: np.ndarray, s: np.ndarray, n: np.ndarray) -> pa.Array:
    """The different ones of n values from each place s, in their order; values are given by their ranks."""
    edge = np.concatenate(([0], np.cumsum(n)))
    of = np.repeat(np.arange(len(s)), n)
    code = np.sort(of << 32 | rank[np.arange(edge[-1]) + (s - edge[:-1])[of]])
    code = code[np.concatenate(([True], code[1:] != code[:-1]))[: len(code)]]
    to = np.searchsorted(code, np.arange(len(s) + 1) << 32) * 8
    return pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(values[code & _LOW])])


def _similar(s: np.ndarray, t: np.ndarray) -> bool:
    short, long = sorted((s, t), key=len)
    if 100 * len(short) < PERCENT * len(long):
        return False
    both = np.count_nonzero(short[np.minimum(np.searchsorted(short, long), len(short) - 1)] == long)
    return 100 * both >= PERCENT * (len(short) + len(long) - both)


@A.lean
def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        same = [_similar(np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
        yield batch.filter(pa.array(same, pa.bool_())).select(["a", "b"])


def _overlaps(values: np.ndarray, at: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How many values two sets share, for pairs of sets of n and m values that stand beside each other from at on."""
    edge = np.concatenate(([0], np.cumsum(n + m)))
    of = np.repeat(np.arange(len(at)), n + m)
    rank = np.unique(values[np.arange(edge[-1]) + (at - edge[:-1])[of]], return_inverse=True)[1]
    code = np.sort(of << 32 | rank)
    return np.bincount(code[1:][code[1:] == code[:-1]] >> 32, minlength=len(at))


def _pairs(i: np.ndarray, name: np.ndarray, part: np.ndarray, values: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of the rows i with the rows after them."""
    n, m = edge[i + 1] - edge[i], edge[i + 2] - edge[i + 1]
    near = (part[i] != part[i + 1]) & (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m))
    i, n, m = i[near], n[near], m[near]
    both = _overlaps(values, edge[i], n, m)
    i = i[100 * both >= PERCENT * (n + m - both)]
    return name[i], name[i + 1]


def _among(name: np.ndarray, part: np.ndarray, values: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the rows of one key."""
    size = np.diff(edge)
    order = np.argsort(size, kind="stable")
    size, root = size[order], np.unique(part, return_inverse=True)[1][order]
    to = np.searchsorted(size, size * 100 // PERCENT, "right")
    values, of = np.concatenate([values[edge[k] : edge[k + 1]] for k in order]), np.repeat(np.arange(len(order)), size)
    edge = np.concatenate(([0], np.cumsum(size)))
    a, b = [], []
    for i in range(len(order) - 1):
        if to[i] <= i + 1 or (root[i + 1 : to[i]] == root[i]).all():
            continue
        mine, rest = values[edge[i] : edge[i + 1]], values[edge[i + 1] : edge[to[i]]]
        hit = mine[np.minimum(np.searchsorted(mine, rest), len(mine) - 1)] == rest
        both = np.bincount(of[edge[i + 1] : edge[to[i]]][hit] - i - 1, minlength=to[i] - i - 1)
        for j in i + 1 + np.flatnonzero(100 * both >= PERCENT * (size[i] + size[i + 1 : to[i]] - both)):
            if root[j] != root[i]:
                a.append(order[i])
                b.append(order[j])
                root[root == root[j]] = root[i]
    return name[a], name[b]


@A.lean
def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that connect the classes of each key, from rows in the order of keys; classes of one part need none."""

    def links(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.concat_batches(held)
        name = rows.column("name").to_numpy()
        part = rows.column("part").to_numpy() if "part" in rows.schema.names else name
        sets = rows.column("shingles")
        edge = np.frombuffer(sets.buffers()[1], np.int32)[sets.offset : sets.offset + len(sets) + 1].astype(np.int64) // 8
        values = np.frombuffer(sets.buffers()[2], _U)
        first = _firsts(rows.column("key").to_numpy())
        many = np.diff(np.append(first, len(rows)))
        found = [_pairs(first[many == 2], name, part, values, edge)]
        for i, n in zip(first[many > 2].tolist(), many[many > 2].tolist(), strict=True):
            found.append(_among(name[i : i + n], part[i : i + n], values, edge[i : i + n + 1]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    held: list[pa.RecordBatch] = []  # rows of one key, which may go on in the next batch
    for batch in batches:
        key = batch.column("key").to_numpy()
        if not len(key):
            continue
        if key[0] == key[-1] and (not held or held[0].column("key")[0].as_py() == key[0]):
            held.append(batch)
            continue
        last = int(np.flatnonzero(key == key[-1])[0])
        yield links([*held, batch.slice(0, last)])
        held = [batch.slice(last)]
    if held:
        yield links(held)


@A.lean
def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, name, size, s): a row for each shingle of each set."""
    for batch in batches:
        sets = [np.frombuffer(s.as_buffer(), np.int64) for s in batch.column("shingles")]
        if sets:
            n = np.array([len(s) for s in sets])
            at = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(at), batch.column("name").take(at), pa.array(np.repeat(n, n).astype(np.int32)), pa.array(np.concatenate(sets))], names=["key", "name", "size", "s"])


def _of_large_keys(sets: DataFrame, most: int, partitions: int) -> DataFrame:
    """Links that connect the classes of each key, from written sets (key, name, shingles), a row for each key and name.

    Sets linked with the first one of their key are a part. Of two sets alike to PERCENT, each holds
    that share of the other, so among the rarest `size - share + 1` shingles of each is a common one:
    sets that share such a shingle and are in several parts are compared, in cells of two blocks.
    """
    first = sets.groupBy("key").agg(F.min_by(F.struct("name", "shingles"), "name").alias("c"))
    pairs = sets.join(first, "key").where("name <> c.name").select(F.col("c.name").alias("a"), F.col("name").alias("b"), F.col("c.shingles").alias("x"), F.col("shingles").alias("y"))
    star = written(pairs.mapInArrow(_compared, "a long, b long"), "star")
    part = components(star).select(F.col("node").alias("name"), "component")

    each = sets.mapInArrow(_shingles, "key long, name long, size int, s long")
    shared = each.groupBy("key", "s").agg(F.count("*").alias("n")).where("n > 1")
    rank = F.row_number().over(Window.partitionBy("key", "name").orderBy(F.coalesce("n", F.lit(1)), "s"))
    rare = each.join(shared, ["key", "s"], "left").withColumn("rank", rank).where(F.expr(f"n is not null and rank <= size - (size * {PERCENT} + 99) div 100 + 1"))
    rare = written(rare.select("key", "s", "name").join(part, "name", "left").select("key", "s", "name", F.coalesce("component", "name").alias("part")), "rare")
    several = rare.groupBy("key", "s").agg(F.ceil(F.count("*") / most).alias("many"), F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi")
    x = rare.join(several.select("key", "s", "many"), ["key", "s"]).withColumn("block", F.expr("pmod(xxhash64(name), many)")).withColumn("o", F.explode(F.expr("sequence(0L, many - 1)")))
    cells = x.select("key", "name", "part", F.xxhash64("key", "s", F.least("block", "o"), F.greatest("block", "o")).alias("cell")).join(sets, ["key", "name"])
    dealt = cells.select(F.col("cell").alias("key"), "name", "part", "shingles").repartition(partitions, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(_linked, "a long, b long").unionByName(star)


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, first_word, n_words, component_id, first_doc, kept): a row for each paragraph whose cluster spans documents, in the order of first_doc."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    many = max(4, int((rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0) / BUCKET_BYTES))
    partitions = min(many, PARTITIONS)
    packed = rows.mapInArrow(_made(many), _PACKED).repartition(partitions, "bucket").sortWithinPartitions("bucket")
    found = written(packed.mapInArrow(_collided(HOT), _FOUND), "paragraphs", F.max("kind"))

    def sets(kind: int) -> DataFrame:
        # bands whose keys hold the same classes want the same sets; the shuffles by id serve what is made distinct, too
        wanted = found.where(F.col("kind") == kind).select(F.col("doc").alias("id"), "key", "name", "start", "size").repartition("id").distinct()
        lists = written(wanted.groupBy("id").agg(F.collect_list(F.struct("key", "name", "start", "size")).alias("wanted")), "wanted")
        texts = rows.join(narrow(lists.select("id")), "id", "left_semi").repartition("id")
        return texts.dropDuplicates(["id", "text"]).hint("merge").join(lists, "id").select("text", "wanted").mapInArrow(_with_sets, "key long, name long, shingles binary")

    links = sets(1).repartition(partitions, "key").sortWithinPartitions("key").mapInArrow(_linked, "a long, b long")
    if found.stats[0] == 3:
        links = links.unionByName(_of_large_keys(written(sets(3).dropDuplicates(["key", "name"]), "sets"), HOT, partitions))
    parts = written(components(written(links, "links")), "components")

    holders = found.where("kind in (1, 2, 3)").select("name", "doc", "start", "size").join(parts.select(F.col("node").alias("name")), "name", "left_semi")
    units = found.where("kind = 0").select("name", "doc", "start", "size").unionByName(holders).distinct()
    units = units.join(parts, F.col("name") == F.col("node"), "left").select("doc", "start", "size", F.coalesce("component", "name").alias("component_id"))
    first = units.groupBy("component_id").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last")).where("first_doc < last").drop("last")
    out = units.join(first, "component_id")
    out = out.orderBy("first_doc", "doc", "start", "size")
    return out.select(F.col("doc").alias(doc_id), F.col("start").cast("long").alias("first_word"), F.col("size").cast("long").alias("n_words"), "component_id", "first_doc", (F.col("doc") == F.col("first_doc")).alias("kept"))
