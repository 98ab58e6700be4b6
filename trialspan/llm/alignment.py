"""Alignment of two tokenizers over a corpus by distinct segments.

Texts, each with a blank before it, are split before every run of blanks that follows something
other than white space. No token of either vocabulary reaches across such a place, which is
verified on both vocabularies when they are loaded, and the byte-level tokenizer's own pattern
starts anew there. So the tokens of a text are the tokens of its segments in a row, and

1. texts are coded block by block, a block being some whole texts of SLICE bytes or one longer
   text: its distinct segments, and for each document their numbers;
2. segments are dealt to buckets by their hashes, packed into one row for each block and bucket;
   each distinct segment of a bucket, so of the corpus, is tokenised by both once;
3. the tokens go back to the blocks that hold the segment, again packed. Documents are composed
   from them and the blocks' codes: counts add, groups follow each other.

How many documents hold a pair of ids linked is counted block by block and added up. The counts
are broadcast while they are at most PAIRS, and joined to the distinct pairs of each block beyond that.

The first tokenizer is a byte-level BPE without a normaliser (a tokenizers JSON file), the second
a BPE of pieces that adds a blank and keeps white space (a sentencepiece model). Both files must be at their path on all executors.

Defined cases: texts that are null or empty, or that either tokenizer does not give back byte by
byte (as with a U+2581 of their own), have no tokens, and their links are not counted. Each row
is a document, repeated ids or not. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from trialspan.llm import _arrays as A
from trialspan.llm._store import bounded_batches, col, written

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of whole texts in a block.
SLICE = 4 << 20
#: Bytes of text for each bucket of segments, and segments that are tokenised at once.
BUCKET_BYTES, AT_ONCE = 16 << 20, 10_000
#: Documents times pairs of a block that are marked at once.
CELLS = 1 << 24
#: Pairs of ids whose counts are broadcast, 24 bytes each.
PAIRS = 1 << 20
_BLANK = 0x20
#: White space as one byte, and as the two or three bytes of its UTF-8 form.
_WHITE = np.zeros(256, bool)
_WHITE[[c for c in range(128) if chr(c).isspace()]] = True
_WIDE = [int.from_bytes(chr(c).encode(), "big") for c in range(0x80, 0x3001) if chr(c).isspace()]


def breaks(data: np.ndarray) -> np.ndarray:
    """Places of the blanks that follow something other than white space."""
    at = np.flatnonzero((data[1:] == _BLANK) & ~_WHITE[data[:-1]]) + 1
    wide = np.flatnonzero(data[at - 1] >= 0x80)
    if len(wide):
        before = [np.where(at[wide] >= k, data[np.maximum(at[wide] - k, 0)], 0).astype(np.int64) for k in (1, 2, 3)]
        two = before[0] | before[1] << 8
        at = np.delete(at, wide[np.isin(two, _WIDE) | np.isin(two | before[2] << 16, _WIDE)])
    return at


def segmented(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, bounds of the segments in them, segments of each text) of texts with a blank before each; empty texts have none."""
    n = np.diff(off)
    full = np.flatnonzero(n > 0)
    rank = np.repeat(np.arange(1, len(full) + 1), n[full])
    out = np.full(len(data) + len(full), _BLANK, np.uint8)
    out[np.arange(len(data)) + rank] = data
    starts = off[full] + np.arange(len(full))
    new = np.zeros(len(out), bool)
    new[breaks(out)] = True
    new[starts] = True
    first = np.flatnonzero(new)
    many = np.zeros(len(n), np.int64)
    many[full] = np.diff(np.append(np.searchsorted(first, starts), len(first)))
    return out, np.append(first, len(out)), many


class Pair:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a: str, b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True  # their strings in a text are text
        shape = json.loads(self.a.to_str())
        cut = shape["pre_tokenizer"] or {}
        if shape["normalizer"] or cut.get("type") != "ByteLevel" or not cut.get("use_regex") or cut.get("add_prefix_space"):
            raise ValueError(f"{a} is not a plain byte-level tokenizer")
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that byte-level tokens show as themselves
        byte = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(sorted(set(range(256)) - set(shown)))}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, k in self.a.get_vocab(with_added_tokens=False).items():
            self.a_bytes[k] = bytes(byte[c] for c in token)
        piece = self.b.id_to_piece
        self.b_bytes = [bytes([int(piece(k)[3:5], 16)]) if self.b.is_byte(k) else piece(k).replace("▁", " ").encode() for k in range(self.b.vocab_size())]
        for path, tokens in ((a, self.a_bytes), (b, self.b_bytes)):
            if len(breaks(np.frombuffer(b"\n".join(tokens), np.uint8))):
                raise ValueError(f"{path} has a token that reaches across a blank after other text")
        if b"".join(self.b_bytes[k] for k in self.b.encode("a  b ")) != b" a  b ":
            raise ValueError(f"{b} does not add a blank and keep white space")
        self.blank = self.b.encode("a ")[len(self.b.encode("a")) :]  # a segment of one blank, which cannot be encoded alone
        self.a_size, self.b_size = (np.array([len(t) for t in tokens], np.int64) for tokens in (self.a_bytes, self.b_bytes))
        self.a_text, self.b_text = ([str(k) for k in range(len(tokens))] for tokens in (self.a_bytes, self.b_bytes))

    def encoded(self, segments: list[bytes]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of each segment; none for segments that one of both does not give back."""
        texts = [s.decode() for s in segments]
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = [x if len(s) > 1 else self.blank for x, s in zip(self.b.encode([t[1:] for t in texts], num_threads=1), segments, strict=True)]
        same = lambda ids, tokens, s: b"".join(map(tokens.__getitem__, ids)) == s
        for k, s in enumerate(segments):
            if not (same(a[k], self.a_bytes, s) and same(b[k], self.b_bytes, s)):
                a[k] = b[k] = []
        return a, b


@lru_cache(maxsize=2)
def pair(a: str, b: str) -> Pair:
    """Loaded once a worker."""
    return Pair(a, b)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)))


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of runs of so many from each start, run after run."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


_PACKED = "block long, many array<long>, codes binary, packed array<struct<bucket: int, at: binary, sizes: binary, bytes: binary>>"


def blocked(docs: DataFrame, buckets: int, doc_id: str, text: str) -> DataFrame:
    """(block, ids, many, codes, packed): a row for each block; a document's codes are the numbers in the block of its segments."""
    rows = docs.select(col(doc_id).alias("id"), col(text).alias("text"))
    block, *more = StructType.fromDDL(_PACKED).fields
    out = StructType([block, StructField("ids", ArrayType(rows.schema["id"].dataType)), *more])

    def packed(segments: pa.Array) -> pa.Array:
        _, _, off, data = next(A.slices(segments, 1 << 62), (0, 0, np.zeros(1, np.int64), np.empty(0, np.uint8)))
        bucket, size = (A.spans(A.prefix(data), off[:-1], off[1:]) % np.uint64(buckets)).astype(np.int64), np.diff(off)
        order = np.argsort(bucket, kind="stable")
        first = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        parts = [order[lo:hi] for lo, hi in zip(first, [*first[1:], len(order)], strict=True)]
        fields = [[A.planes(np.diff(p, prepend=0)) for p in parts], [A.planes(size[p]) for p in parts], [A.squeezed(data[_places(off[p], size[p])].tobytes()) for p in parts]]
        return pa.StructArray.from_arrays([pa.array(bucket[order[first]], pa.int32()), *(pa.array(f, pa.binary()) for f in fields)], names=["bucket", "at", "sizes", "bytes"])

    @A.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        for batch in batches:
            for i, j, off, data in A.slices(batch.column("text"), SLICE):
                full, bounds, many = segmented(data, off)
                found = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(full)]).dictionary_encode()
                name = pa.array([uuid.uuid4().int >> 65], pa.int64())
                codes = pa.array([A.planes(found.indices.to_numpy())], pa.binary())
                yield pa.RecordBatch.from_arrays([name, one(batch.column("id")[i:j]), one(pa.array(many)), codes, one(packed(found.dictionary.cast(pa.binary())))], names=out.names)

    return rows.mapInArrow(run, out)


_TOKENS = "at binary, n_a binary, n_b binary, a binary, b binary"


def tokenised(packed: DataFrame, a: str, b: str) -> DataFrame:
    """(block, at, n_a, n_b, a, b) for each row of packed (bucket, block, at, sizes, bytes): the ids of both, none where a segment is not given back."""

    @A.lean_table
    def run(rows: pa.Table) -> pa.Table:
        both, many = pair(a, b), [A.numbers(x) for x in rows.column("sizes")]
        bounds, data = _starts(np.concatenate(many)), b"".join(map(A.restored, rows.column("bytes")))
        found = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        sizes, ids = ([], []), ([], [])
        for lo in range(0, len(found.dictionary), AT_ONCE):
            for k, lists in enumerate(both.encoded(found.dictionary[lo : lo + AT_ONCE].to_pylist())):
                sizes[k].append(np.fromiter(map(len, lists), np.int64, len(lists)))
                ids[k].append(np.fromiter((x for one in lists for x in one), np.int64))
        sizes, ids = (tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in parts) for parts in (sizes, ids))
        starts, code = [_starts(s) for s in sizes], found.indices.to_numpy().astype(np.int64)
        bounds = _starts(np.array([len(n) for n in many]))
        out: dict[str, list[bytes]] = {"n_a": [], "n_b": [], "a": [], "b": []}
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            for k, side in enumerate("ab"):
                here = code[lo:hi]
                out[f"n_{side}"].append(A.planes(sizes[k][here]))
                out[side].append(A.planes(ids[k][_places(starts[k][here], sizes[k][here])]))
        return pa.table({"block": rows.column("block"), "at": rows.column("at"), **{c: pa.array(v, pa.binary()) for c, v in out.items()}})

    return packed.groupBy("bucket").applyInArrow(run, f"block long, {_TOKENS}")


@A.lean_table
def _together(parts: pa.Table) -> pa.Table:
    """The tokens of a block's segments in the order of their numbers."""
    numbers = lambda c: [A.numbers(x) for x in parts.column(c)]
    order = np.argsort(np.concatenate([np.cumsum(n) for n in numbers("at")]))
    out = {"block": parts.column("block").slice(0, 1)}
    for side in "ab":
        sizes = np.concatenate(numbers(f"n_{side}"))
        starts = _starts(sizes)[:-1][order]
        out[f"n_{side}"] = pa.array([A.planes(sizes[order])], pa.binary())
        out[side] = pa.array([A.planes(np.concatenate(numbers(side))[_places(starts, sizes[order])])], pa.binary())
    return pa.table(out)


class _Block:
    """The documents of one block, and the groups and links of its segments."""

    def __init__(self, row: dict[str, pa.Scalar], both: Pair):
        self.both = both
        # What a row lacks is empty: a block of empty texts has no tokens, and its links need no documents.
        self.many = row["many"].values.to_numpy() if "many" in row else np.empty(0, np.int64)
        self.codes, self.n_a, self.n_b, self.a, self.b = (A.numbers(row[c]) if c in row else np.empty(0, np.int64) for c in ("codes", "n_a", "n_b", "a", "b"))
        self.doc = np.repeat(np.arange(len(self.many)), self.many)
        self.good = np.bincount(self.doc, self.n_a[self.codes] == 0, len(self.many)) == 0
        bounds = [np.cumsum(size[ids]) for size, ids in ((both.a_size, self.a), (both.b_size, self.b))]
        total = int(bounds[0][-1]) if len(bounds[0]) else 0
        ends = np.zeros((2, total + 1), bool)
        ends[0, bounds[0]] = ends[1, bounds[1]] = True
        before = [np.cumsum(e) - e for e in ends]  # tokens that end before each byte
        every = np.flatnonzero(ends[0] | ends[1])  # between two of these one token of each overlaps
        self.links = self.a[before[0][every]] << 32 | self.b[before[1][every]]
        both_end = np.flatnonzero(ends[0] & ends[1])
        self.to_a, self.to_b = (n[both_end] + 1 for n in before)
        own = np.concatenate(([0], bounds[0]))[np.cumsum(self.n_a)]  # where segments end
        self.n_links, self.n_groups = (np.diff(np.searchsorted(x, own, "right"), prepend=0) for x in (every, both_end))

    def held(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct pairs of the block, documents that hold each)."""
        pairs, at = np.unique(self.links, return_inverse=True)
        docs, start, ends = np.zeros(len(pairs), np.int64), _starts(self.n_links), np.cumsum(self.many)
        step = max(1, CELLS // max(len(pairs), 1))
        for lo in range(0, len(self.many), step):
            hi = min(lo + step, len(self.many))
            span = slice(ends[lo] - self.many[lo], ends[hi - 1])
            keep = self.good[self.doc[span]]
            code, doc = self.codes[span][keep], self.doc[span][keep] - lo
            n = self.n_links[code]
            seen = np.zeros((hi - lo, len(pairs)), bool)
            seen[np.repeat(doc, n), at[_places(start[code], n)]] = True
            docs += seen.sum(0)
        return pairs, docs

    def summed(self, of_segment: np.ndarray) -> np.ndarray:
        """Sums over the segments of each document that both tokenizers give back, else 0."""
        after, ends = _starts(of_segment[self.codes]), np.cumsum(self.many)
        return np.where(self.good, after[ends] - after[ends - self.many], 0)

    def groups(self) -> list[str]:
        a, b = [self.both.a_text[k] for k in self.a.tolist()], [self.both.b_text[k] for k in self.b.tolist()]
        to_a, to_b = self.to_a.tolist(), self.to_b.tolist()
        every = [f"{a[i] if j - i == 1 else ','.join(a[i:j])}|{b[k] if m - k == 1 else ','.join(b[k:m])}" for i, j, k, m in zip([0, *to_a[:-1]], to_a, [0, *to_b[:-1]], to_b, strict=True)]
        bounds = _starts(self.n_groups).tolist()
        of_segment = [every[i] if j - i == 1 else ";".join(every[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        codes, ends = self.codes.tolist(), np.cumsum(self.many).tolist()
        return [";".join(map(of_segment.__getitem__, codes[i:j])) if good else "" for i, j, good in zip([0, *ends[:-1]], ends, self.good.tolist(), strict=True)]

    def composed(self, ids: pa.Array, docs: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
        """A row for each document; docs and best tell of each link of the segments how many documents hold its pair, and whether that is the most."""
        of = lambda values: np.add.reduceat(np.append(values, 0), _starts(self.n_links)[:-1]) * (self.n_links > 0) if len(self.n_links) else self.n_links
        sums = [self.n_a, self.n_b, self.n_groups, self.n_links, of(best), of(docs)]
        return pa.RecordBatch.from_arrays([ids, *(pa.array(self.summed(x), pa.int64()) for x in sums), pa.array(self.groups(), pa.string())], names=["id", *_SUMS, "groups"])


_SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _row(*tables: pa.Table) -> dict[str, pa.Scalar]:
    """The columns of tables of one row each; an empty one adds none."""
    return {c: t.column(c)[0] for t in tables if t.num_rows for c in t.schema.names}


def aligned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", a: str = BYTE_BPE, b: str = PIECE_BPE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) for each row of docs; groups as `a1,a2|b1;a3|b2,b3`."""
    spark = docs.sparkSession
    bounded_batches(spark)
    pair(a, b)  # what does not fit fails here
    size = docs.agg(F.sum(F.octet_length(col(text)))).head()[0] or 0
    coded = written(blocked(docs, max(4, int(size / BUCKET_BYTES)), doc_id, text), "coded")
    packed = coded.select(F.col("block").alias("of"), F.explode("packed").alias("p")).select(F.col("of").alias("block"), "p.*")
    tokens = "block long, n_a binary, n_b binary, a binary, b binary"
    blocks = written(tokenised(packed, a, b).groupBy("block").applyInArrow(_together, tokens), "tokens")

    def with_codes(columns: list[str], values: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
        """run(codes of a block, values of the same block), block by block."""
        return coded.select("block", *columns).groupBy("block").cogroup(values.groupBy("block")).applyInArrow(A.lean_tables(run), schema)

    def count(codes: pa.Table, held: pa.Table) -> pa.Table:
        pairs, n = _Block(_row(codes, held), pair(a, b)).held()
        return pa.table({"pair": pa.array(pairs[n > 0], pa.int64()), "docs": pa.array(n[n > 0], pa.int64())})

    counts = with_codes(["many", "codes"], blocks, count, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))
    most = F.max("docs").over(Window.partitionBy(F.shiftright("pair", 32)))
    counts = written(counts.select("pair", "docs", (F.col("docs") == most).cast("long").alias("best")), "pairs", F.count(F.lit(1)))

    out = StructType().add("id", docs.select(col(doc_id)).schema[0].dataType)
    for c in _SUMS:
        out = out.add(c, "long")
    out = out.add("groups", "string")
    if counts.stats[0] <= PAIRS:
        table = counts.orderBy("pair").toArrow()
        shared = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "docs", "best")))
        weighed = blocks
        known = lambda row: shared.value
    else:

        @A.lean
        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(len(batch)):
                    row = _row(batch.slice(k, 1))
                    pairs = np.unique(_Block(row, pair(a, b)).links)
                    yield pa.RecordBatch.from_arrays([pa.array([row["block"].as_py()] * len(pairs), pa.int64()), pa.array(pairs)], names=["of", "pair"])

        @A.lean_tables
        def with_weights(held: pa.Table, weights: pa.Table) -> pa.Table:
            weights = weights.sort_by("pair")
            raw = {c: pa.array([A.squeezed(weights.column(c).to_numpy().astype(np.int64).tobytes())], pa.binary()) for c in ("pair", "docs", "best")}
            return pa.table({**{c: held.column(c) for c in held.schema.names}, **raw})

        weights = blocks.mapInArrow(asked, "of long, pair long").join(counts, "pair")
        weighed = blocks.groupBy("block").cogroup(weights.groupBy("of")).applyInArrow(with_weights, f"{tokens}, pair binary, docs binary, best binary")
        known = lambda row: tuple(np.frombuffer(A.restored(row[c]), np.int64) if c in row else np.empty(0, np.int64) for c in ("pair", "docs", "best"))

    def compose(codes: pa.Table, held: pa.Table) -> pa.Table:
        row = _row(codes, held)
        return pa.Table.from_batches([_weighed(_Block(row, pair(a, b)), row["ids"].values, *known(row))])

    return with_codes(["ids", "many", "codes"], weighed, compose, out).select(col("id").alias(doc_id), *_SUMS, "groups")


def _weighed(block: _Block, ids: pa.Array, pairs: np.ndarray, docs: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    """The block's documents, with the counts of sorted pairs; pairs of texts without tokens may be missing there."""
    if not len(pairs):
        none = np.zeros(len(block.links), np.int64)
        return block.composed(ids, none, none)
    at = np.minimum(np.searchsorted(pairs, block.links), len(pairs) - 1)
    known = pairs[at] == block.links
    return block.composed(ids, docs[at] * known, best[at] * known)
