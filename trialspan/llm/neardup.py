"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A set of distinct shingles is sketched in rounds: round i throws every element into one of
the coordinates and a coordinate keeps the least value of the first round that reached it;
after `SIZE` rounds each coordinate still empty is filled by a round of its own. So every
coordinate fills, and the share of equal coordinates is concentrated around the Jaccard
similarity at least as well as with independent functions.

Equal sets become one class. Classes that share a band are candidates: in each bucket all are
compared with the first, on their full sets, and verified links give parts. In a bucket that
still holds several parts, sketches tell which parts may be linked, by the concentration bound;
parts so connected, a family, are compared on full sets, in blocks of bounded size where pairs
of one part never meet. No candidate is capped, and a link is a link only if full sets say so.

Defined cases: a null, empty or wordless text has an empty set and is linked with nothing. A
text with fewer words than a shingle is one shingle. A row without an id is linked with
nothing and its component is null. Repeated rows each get a row, with the same component. Ids
are integers; rows that repeat an id with different texts are one document with the links of
all of them. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspan.llm import _arrays as A
from trialspan.llm._components import components
from trialspan.llm._store import bounded_batches, col, dropped, narrow, written

SIZE = 128
BITS = 7
#: 25 bands of 5 coordinates: a pair at 0.85 shares no band with probability 4e-7.
BANDS, ROWS = 25, 5
#: Standard deviations under the threshold from which an estimate rules a pair out.
DEVIATIONS = 5.0
#: Shingles in a block of a family, and sketches in a block of a bucket; a task holds two blocks.
BLOCK, BLOCK_ROWS = 1 << 20, 1 << 13
SHINGLE = 5
_ROUND = np.random.default_rng(11).integers(0, 1 << 63, 2 * SIZE, dtype=np.uint64)
_BAND = np.random.default_rng(13).integers(0, 1 << 63, BANDS, dtype=np.uint64)
_U = np.uint64


def sketch(elements: np.ndarray) -> np.ndarray:
    """The coordinates of a set of distinct 64-bit values that is not empty."""
    out, filled, first = np.zeros(SIZE, _U), np.zeros(SIZE, bool), 0
    many = max(1, min(SIZE, 1024 // len(elements)))
    while first < SIZE and not filled.all():
        n = min(many, SIZE - first)
        h = A.mix(elements[None, :] ^ _ROUND[first : first + n, None])
        rounds = np.arange(first, first + n, dtype=_U)[:, None]
        keys = np.sort(((h >> _U(57)) << _U(57) | rounds << _U(50) | (h << _U(7)) >> _U(14)).ravel())
        coordinate = (keys >> _U(57)).astype(np.int64)
        at = np.flatnonzero(np.diff(coordinate, prepend=-1))
        at = at[~filled[coordinate[at]]]
        out[coordinate[at]] = keys[at]
        filled[coordinate[at]] = True
        first += n
    rest = np.flatnonzero(~filled)
    if len(rest):
        out[rest] = A.mix(elements[None, :] ^ _ROUND[SIZE + rest][:, None]).min(1)
    return A.mix(out)


def _sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, _, off, data in A.slices(column):
        data = A.LOWER[data]
        starts, ends, first = A.words(data, off)
        h = A.spans(A.prefix(data), starts, ends)
        whole = A.grams(h, n)
        for k in range(len(off) - 1):
            a, b = first[k], first[k + 1]
            yield np.unique(whole[a : b - n + 1]) if b - a >= n else A.sequence(h[a:b]) if b > a else h[:0]


def _sketched(n: int):
    @A.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = len(batch)
            size, one, two = np.zeros(rows, np.int64), np.zeros(rows, _U), np.zeros(rows, _U)
            bands, marks = np.zeros((rows, BANDS), _U), []
            for k, s in enumerate(_sets(batch.column("text"), n)):
                size[k] = len(s)
                if len(s):
                    one[k], two[k] = A.mix(s + _U(1)).sum(), np.bitwise_xor.reduce(A.mix(s + _U(2)))
                    c = sketch(s)
                    bands[k] = A.mix((c[: BANDS * ROWS].reshape(BANDS, ROWS) * A._LANES[:ROWS]).sum(1) ^ _BAND)
                    marks.append((c & _U(255)).astype(np.uint8).tobytes())
                else:
                    marks.append(b"")
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, rows * BANDS + 1, BANDS), pa.int32()), pa.array(bands.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), keys, A.binary(marks)], names=["id", "n", "one", "two", "bands", "marks"])

    return run


def _set_bytes(n: int):
    @A.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_sets(batch.column("text"), n))
            one = np.array([A.mix(s + _U(1)).sum(dtype=_U) for s in sets], _U).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(one), A.binary([s.tobytes() for s in sets])], names=["id", "one", "shingles"])

    return run


def _least_equal(percent: int) -> float:
    """Equal coordinates that a pair at the threshold has, all but surely."""
    share = percent / 100
    return SIZE * share - DEVIATIONS * (SIZE * share * (1 - share)) ** 0.5


def _alike(percent: int):
    least = _least_equal(percent)

    @A.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            same = [int((np.frombuffer(p, np.uint8) == np.frombuffer(q, np.uint8)).sum()) >= least for p, q in zip(x, y, strict=True)]
            yield batch.filter(pa.array(same, pa.bool_())).select(["a", "a1", "b", "b1"])

    return run


def _spans_parts(percent: int, verify: bool):
    """Links between parts that a pair in two blocks of a group gives, as many as join parts here: by full sets, or else by sketches that do not rule the pair out."""
    least = _least_equal(percent)

    @A.lean_table
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block").to_numpy()
        lo, hi = table.column("p")[0].as_py(), table.column("q")[0].as_py()
        marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.uint8).reshape(-1, SIZE)
        size = table.column("n").to_numpy()
        parts, root = np.unique(table.column("part").to_numpy(), return_inverse=True)
        sets = [np.frombuffer(x.as_buffer(), _U) for x in table.column("shingles").combine_chunks()] if verify else None
        part = root.copy()
        a, b = [], []
        for i in np.flatnonzero(root != np.bincount(root).argmax()):  # of a pair in two parts, one is not in the largest
            other = np.flatnonzero((root != root[i]) & (block == (hi if block[i] == lo else lo)))
            other = other[np.minimum(size[i], size[other]) * 100 >= percent * np.maximum(size[i], size[other])]
            other = other[(marks[other] == marks[i]).sum(1) >= least]
            for k in other:
                if root[k] != root[i] and (not verify or _similar(sets[i], sets[k], percent)):
                    a.append(parts[part[i]])
                    b.append(parts[part[k]])
                    root[root == root[k]] = root[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _similar(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    if len(s) > len(t):
        s, t = t, s
    both = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
    return 100 * both >= percent * (len(s) + len(t) - both)


def _linked(percent: int):
    @A.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = []
            for p, q in zip(batch.column("x"), batch.column("y"), strict=True):
                same.append(_similar(np.frombuffer(p.as_buffer(), _U), np.frombuffer(q.as_buffer(), _U), percent))
            yield batch.filter(pa.array(same, pa.bool_())).select(["a", "b"])

    return run


def _with_both(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    left = table.select(F.col("id").alias("a"), F.col("one").alias("a1"), F.col(value).alias("x"))
    right = table.select(F.col("id").alias("b"), F.col("one").alias("b1"), F.col(value).alias("y"))
    return pairs.join(left, ["a", "a1"]).join(right, ["b", "b1"]).select("a", "a1", "b", "b1", "x", "y")


def _block_pairs(rows: DataFrame, group: str, weight: Column, bound: int) -> DataFrame:
    """rows with block, p and q: those of groups with several parts, once for each pair of blocks that may hold two parts.

    A part over the bound is dealt by hash to blocks of its own, which are never compared with
    each other; the other parts share blocks. So a group that is one large part and some small
    ones costs as many copies of the small ones as the large one has blocks, and one of the large.
    """
    sized = rows.groupBy(group, "part").agg(F.sum(weight).alias("w"))
    blocks = F.struct(F.col("part"), F.ceil(F.col("w") / bound).alias("n"))
    of = sized.groupBy(group).agg(F.count("*").alias("parts"), F.ceil(F.coalesce(F.sum(F.when(F.col("w") < bound, F.col("w"))), F.lit(0)) / bound).alias("mixed"), F.collect_list(F.when(F.col("w") >= bound, blocks)).alias("big")).where("parts > 1")
    x = rows.join(of, group).withColumn("k", F.expr("array_position(transform(big, x -> x.part), part)"))
    x = x.withColumn("lo", F.expr("mixed + aggregate(slice(big, 1, greatest(int(k) - 1, 0)), 0L, (a, x) -> a + x.n)")).withColumn("many", F.expr("if(k > 0, big[int(k) - 1].n, mixed)"))
    x = x.withColumn("block", F.expr("if(k > 0, lo + pmod(xxhash64(id), many), pmod(xxhash64(part), many))")).withColumn("all", F.expr("mixed + aggregate(big, 0L, (a, x) -> a + x.n)"))
    x = x.withColumn("o", F.explode(F.expr("filter(sequence(0L, all - 1), o -> k = 0 or o < lo or o >= lo + many)")))
    return x.select(*rows.columns, "block", F.least("block", "o").alias("p"), F.greatest("block", "o").alias("q"))


def _linked_parts(rows: DataFrame, group: str, weight: Column, bound: int, payload: list[tuple[DataFrame, str]], percent: int) -> DataFrame:
    """(a, b): parts that pairs in one group link."""
    blocks = _block_pairs(rows, group, weight, bound)
    for table, value in payload:
        blocks = blocks.join(table.select("id", "one", value), ["id", "one"])
    verify = any(value == "shingles" for _, value in payload)
    columns = ["block", "p", "q", "part", "n", *(value for _, value in payload)]
    return blocks.select(group, *columns).groupBy(group, "p", "q").applyInArrow(_spans_parts(percent, verify), "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row; links have 100 * intersection >= percent * union, percent from 80."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(col(doc_id).cast("long").alias("id"), col(text).alias("text"))
    made = written(rows.mapInArrow(_sketched(shingle), "id long, n long, one long, two long, bands array<long>, marks binary"), "sketches")
    sets = made.where("n > 0 and id is not null")
    classes = written(sets.groupBy("one", "two", "n").agg(F.min_by(F.struct("id", "bands", "marks"), "id").alias("r")).select("one", "two", "n", "r.id", "r.bands", "r.marks"), "classes")
    marks = classes.select("id", "one", "marks")

    keyed = classes.select("id", "one", "n", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("id", "one")).alias("centre")).where("size > 1").drop("size")
    members = written(keyed.join(buckets, "key"), "members")
    needed = members.select("id", "one").distinct()
    full = written(rows.join(narrow(needed.select("id").distinct()), "id", "left_semi").mapInArrow(_set_bytes(shingle), "id long, one long, shingles binary").dropDuplicates(["id", "one"]).join(needed, ["id", "one"], "left_semi"), "sets")

    star = members.where("id <> centre.id").select(F.col("centre.id").alias("a"), F.col("centre.one").alias("a1"), F.col("id").alias("b"), F.col("one").alias("b1")).distinct()
    near = _with_both(star, marks, "marks").mapInArrow(_alike(percent), "a long, a1 long, b long, b1 long")
    links = _with_both(near, full, "shingles").mapInArrow(_linked(percent), "a long, b long")
    several = sets.groupBy("id").agg(F.min("one").alias("lo"), F.max("one").alias("hi")).where("lo <> hi").select("id")  # texts of one id belong together
    own = sets.join(several, "id", "left_semi").select("id", "one", "two", "n").join(classes.select("one", "two", "n", F.col("id").alias("a")), ["one", "two", "n"]).select("a", F.col("id").alias("b"))
    found = written(components(links.unionByName(own)), "parts")

    part = F.coalesce("component", "id").alias("part")
    inside = members.join(found, F.col("id") == F.col("node"), "left").select("key", "id", "one", "n", part)
    maybe = written(_linked_parts(inside, "key", F.lit(1), BLOCK_ROWS, [(marks, "marks")], percent), "maybe", F.count(F.lit(1)))
    if maybe.stats[0]:
        family = components(maybe).select(F.col("node").alias("part"), F.col("component").alias("family"))
        nodes = inside.select("id", "one", "n", "part").distinct().join(family, "part")
        more = written(_linked_parts(nodes, "family", F.col("n"), BLOCK, [(marks, "marks"), (full, "shingles")], percent), "joined", F.count(F.lit(1)))
        if more.stats[0]:
            whole = components(more).select(F.col("node").alias("part"), F.col("component").alias("whole"))
            every = found.select("node", F.col("component").alias("part")).unionByName(whole.select(F.col("part").alias("node"), "part")).distinct()
            after = written(every.join(whole, "part", "left").select("node", F.coalesce("whole", "part").alias("component")), "components")
            dropped(found)
            found = after
        dropped(more)
    dropped(members, full, maybe)
    part = classes.join(found, F.col("id") == F.col("node"), "left").select("one", "two", "n", F.coalesce("component", "id").alias("part"))
    out = made.select("id", "n", "one", "two").join(part, ["one", "two", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("part", "id"))
    out = written(out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept")), "neardup")
    dropped(made, classes, found)
    return out


def survivors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """docs, all columns, with one document of each group; of rows that repeat an id the one with the least text stays."""
    found = near_duplicates(docs, doc_id, text, percent)
    gone = narrow(written(found.where(~F.col("kept")).select(col(doc_id).alias("__id")).distinct(), "gone"))
    columns = [col(c) for c in docs.columns]
    kept = docs.select(F.struct(*columns).alias("row"), col(doc_id).cast("long").alias("__id"), F.coalesce(col(text), F.lit("")).alias("__text")).join(gone, "__id", "left_anti")
    again = written(found.where(col(doc_id).isNotNull()).groupBy(col(doc_id).alias("__id")).count().where("count > 1").select("__id"), "again", F.count(F.lit(1)))
    dropped(found)
    if not again.stats[0]:
        rows = kept.select("row")
    else:
        once = kept.join(again, "__id", "left_semi").groupBy("__id").agg(F.min_by("row", "__text").alias("row")).select("row")
        rows = kept.join(again, "__id", "left_anti").select("row").unionByName(once)
    return rows.select(*(F.col("row")[c].alias(c) for c in docs.columns))
