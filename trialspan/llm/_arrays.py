"""Array kernels over Arrow text columns: slices of whole texts, words, rolling hashes.

A text is never cut. A slice holds as many whole texts as fit its byte limit, and one text
alone if that is longer, so memory follows the longest text and not the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 64, 256, dtype=_U, endpoint=False)
_LANES = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=_U) | _U(1)

#: Bytes that end a word: blank and \x09-\x0D.
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def release() -> None:
    """Gives memory that was freed back to the system."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable) -> Callable:
    """run, a function of batches, that gives what it freed back to the system when its task ends; workers live on between tasks."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def lean_table(run: Callable) -> Callable:
    """run, a function of one table, that gives what it freed back to the system."""

    @wraps(run)
    def wrapped(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            release()

    return wrapped


def lean_tables(run: Callable) -> Callable:
    """run, a function of two tables, that gives what it freed back to the system."""

    def wrapped(left: pa.Table, right: pa.Table) -> pa.Table:
        return lean_table(lambda one: run(one, right))(left)

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a new array."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(size, base & ((1 << 64) - 1), _U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=_U)
    return _powers


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets from 0, bytes) of whole texts; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if n == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, values = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, off[i : j + 1] - off[i], data[off[i] : off[j]]
        i = j


def words(data: np.ndarray, off: np.ndarray, inside: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and the total): runs of bytes that `inside` marks; no run crosses texts."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    here = inside[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, here[:-1]
    before[off[:-1][off[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, here[1:]
    last = off[1:] - 1
    after[last[last >= 0]] = False
    starts, ends = np.flatnonzero(here & ~before), np.flatnonzero(here & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which spans() hashes any run of bytes."""
    n = len(data)
    out = np.zeros(n + 1, _U)
    np.cumsum(_BYTE[data] * _power_tables(n)[0][:n], out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; equal bytes, equal hash, in any slice."""
    inverse = _power_tables(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive hashes, at each position that has n."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, _U)
    out = np.full(m, _U(n))
    for k in range(n):
        out += hashes[k : k + m] * _LANES[k]
    return mix(out)


def sequence(hashes: np.ndarray) -> np.ndarray:
    """One hash of a whole short sequence of hashes, as grams() would give it."""
    return grams(hashes, len(hashes))


def of_rows(first: np.ndarray) -> np.ndarray:
    """The row of each item, from the first item of each row and the total."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


_ZSTD = pa.Codec("zstd", compression_level=3)


def squeezed(raw: bytes) -> bytes:
    """raw, compressed, behind its length."""
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def restored(value: pa.Scalar) -> bytes:
    raw = value.as_buffer()
    return _ZSTD.decompress(raw.slice(8), int.from_bytes(raw.slice(0, 8).to_pybytes(), "little"), asbytes=True)


def planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers byte by byte, compressed: high bytes, mostly 0, stand together."""
    return squeezed(numbers.astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes())


def numbers(value: pa.Scalar) -> np.ndarray:
    raw = np.frombuffer(restored(value), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).reshape(-1).view(np.int32).astype(np.int64)
