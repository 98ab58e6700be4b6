"""Prediction by partial matching over bytes: count, freeze, score.

For every context of up to ORDER bytes the frozen statistics give each next byte an
escape-coded probability: with n of N occurrences and D distinct successors seen, a seen byte
has n/(N+D); the escape mass D/(N+D) is spread over the unseen ones as the next shorter context
has it, renormalised over them (exclusion). Below the empty context every byte is equally
likely. Byte 0 stands before a text.

Contexts are kept as sparse trees, one table an order: the code lengths of all (context, byte)
pairs that any model of a block has seen, under each of its models, and the code lengths of
their escapes. A pair is looked up at the longest order; only pairs that no model has seen go
on to shorter ones. So scores are exact, cost one lookup a byte, and the order is the same
however many models there are. Models are scored in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspan.llm._arrays import lean, mix, release, slices
from trialspan.llm._store import dropped, written

ORDER = 3
#: Bytes of the tables of one block of models, and of one context under one model in them; a model that is larger is a block of its own.
BLOCK_BYTES, CELL_BYTES = 64 << 20, 8
#: Distinct (model, context) counts that a task keeps before it merges them.
PENDING = 1_000_000
_U = np.uint64


def packed(data: np.ndarray, off: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """For each byte its context and itself, as one number, the byte lowest."""
    here = fold[data].astype(np.uint32)
    out = here.copy()
    starts = off[:-1][np.diff(off) > 0]
    for k in range(1, ORDER + 1):
        back = np.zeros(len(here), np.uint32)
        back[k:] = here[:-k] if k < len(here) else 0
        for j in range(k):  # a context does not reach into the text before
            at = starts + j
            back[at[at < len(back)]] = 0
        out |= back << np.uint32(8 * k)
    return out


class Lookup:
    """Places of keys, found by a table of the top bits of their hashes."""

    def __init__(self, keys: np.ndarray):
        self.bits = _U(max(1, int(2 * len(keys)).bit_length()))
        h = mix(keys.astype(_U))
        self.order = np.argsort(h, kind="stable")
        self.keys = keys[self.order].astype(np.uint32)
        self.start = np.searchsorted(h[self.order] >> (_U(64) - self.bits), np.arange((1 << int(self.bits)) + 1, dtype=_U)).astype(np.int32)

    def find(self, q: np.ndarray) -> np.ndarray:
        """The place of each, or -1."""
        out = np.full(len(q), -1, np.int32)
        bucket = (mix(q.astype(_U)) >> (_U(64) - self.bits)).astype(np.int64)
        at, end = self.start[bucket], self.start[bucket + 1]
        open_ = np.flatnonzero(at < end)
        while len(open_):
            here = at[open_]
            hit = self.keys[here] == q[open_]
            out[open_[hit]] = here[hit]
            at[open_] += 1
            open_ = open_[~hit & (here + 1 < end[open_])]
        return out


class Models:
    """Code lengths in bits under the models `names`, from counts (model, key, n) of contexts of ORDER bytes."""

    def __init__(self, names: list[str], model: np.ndarray, key: np.ndarray, n: np.ndarray):
        self.names, many = names, len(names)
        pairs = np.arange(256)
        shape = []
        self.tables: list[tuple[Lookup, np.ndarray, Lookup, np.ndarray]] = []
        for k in range(ORDER + 1):
            union, at = np.unique(key & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            first = np.flatnonzero(np.diff(union >> 8, prepend=-1))
            spread = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(union))))
            below = np.searchsorted(pairs, union & ((1 << 8 * max(k, 1)) - 1)).astype(np.int32)
            look, contexts = Lookup(union), Lookup((union >> 8)[first])
            self.tables.append((look, np.empty((many, len(union)), np.float32), contexts, np.empty((many, len(first)), np.float32)))
            shape.append((at.astype(np.int32), below, first, spread))
            pairs = union
        for m in range(many):  # one model at a time, so that only tables are as wide as there are models
            own = np.flatnonzero(model == m)
            lower = np.full(256, 1.0 / 256)
            for (at, below, first, spread), (look, bits, contexts, escapes) in zip(shape, self.tables, strict=True):
                if not len(first):
                    break
                count, under = np.bincount(at[own], n[own], len(below)), lower[below]
                seen = count > 0
                total, kinds, taken = (np.add.reduceat(x, first) for x in (count, seen.astype(float), under * seen))
                with np.errstate(divide="ignore", invalid="ignore"):
                    escape = np.where(total == 0, 1.0, kinds / (total + kinds) / (1.0 - taken))
                    lower = np.where(seen, count / np.where(kinds == 256, total, total + kinds)[spread], escape[spread] * under)
                    bits[m], escapes[m] = -np.log2(lower[look.order]), -np.log2(escape[contexts.order])

    def summed(self, keys: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code length in bits of each text (rows) under each model (columns)."""
        out = np.zeros((len(off) - 1, len(self.names)))
        full = np.flatnonzero(np.diff(off) > 0)
        if not len(full) or not self.names:
            return out
        look, bits, _, _ = self.tables[ORDER]
        at = look.find(keys)
        rest = np.flatnonzero(at < 0)
        for m in range(len(self.names)):
            value = bits[m][at]
            value[rest] = 0.0
            out[full, m] = np.add.reduceat(value, off[:-1][full], dtype=np.float64)
        of = np.searchsorted(off, rest, "right") - 1
        for k in range(ORDER, -1, -1):  # pairs that no model has seen with k bytes of context
            if not len(rest):
                break
            q = keys[rest] & np.uint32((1 << 8 * (k + 1)) - 1)
            look, bits, contexts, escapes = self.tables[k]
            at = look.find(q) if k < ORDER else np.full(len(q), -1)
            escape = np.where(at < 0, contexts.find(q >> np.uint32(8)), -1)
            for m in range(len(self.names)):
                value = np.where(at >= 0, bits[m][at], np.where(escape >= 0, escapes[m][escape], 0.0))
                out[:, m] += np.bincount(of, value, len(out))
            rest, of = rest[at < 0], of[at < 0]
        out[:, :] += np.bincount(of, minlength=len(out))[:, None] * 8.0  # equally likely bytes
        return out


def fit(rows: DataFrame, fold: np.ndarray) -> list[Models]:
    """Models of all labels in rows (label, text), in the order of labels, in blocks.

    Each task sends the counts of the contexts it saw; the driver gets those of one block at a
    time, as many numbers as its languages have contexts, however large the input.
    """

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

        for batch in batches:
            names = batch.column("label").to_pylist()
            for i, j, off, data in slices(batch.column("text")):
                code = np.array([codes.setdefault(x, len(codes)) for x in names[i:j]], np.int64)
                held.append(np.unique(packed(data, off, fold) | np.repeat(code, np.diff(off)) << 32, return_counts=True))
            if sum(len(k) for k, _ in held) > PENDING:
                held = [merged()]
        if held:
            keys, n = merged()
            for name, c in codes.items():
                at = keys >> 32 == c
                k = keys[at] & 0xFFFFFFFF
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(k), pa.array(n[at])], names=["label", "key", "n"])

    counts = written(rows.select("label", "text").mapInArrow(count, "label string, key long, n long").groupBy("label", "key").agg(F.sum("n").alias("n")), "contexts")
    sizes = sorted(map(tuple, counts.groupBy("label").count().collect()))
    blocks: list[list[str]] = []
    filled = 0
    for name, size in sizes:
        if not blocks or (filled + size) * (len(blocks[-1]) + 1) * CELL_BYTES > BLOCK_BYTES:  # every context stands under every model of its block
            blocks, filled = [*blocks, []], 0
        blocks[-1].append(name)
        filled += size
    out = []
    for names in blocks:
        found = counts.where(F.col("label").isin(names)).toArrow()
        model = pc.index_in(found.column("label"), pa.array(names)).to_numpy()
        out.append(Models(names, model, found.column("key").to_numpy(), found.column("n").to_numpy()))
        del found, model
        release()
    dropped(counts)
    return out
