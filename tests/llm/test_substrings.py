import hashlib
import random

from trialspan.llm import _store, substrings


def brute(rows):
    """By definition: bytes under a 50-byte string that also starts in a document with a smaller id."""
    first: dict[bytes, int] = {}
    texts = {k: (t or "").encode() for k, t in rows if k is not None}
    for k in sorted(texts):
        for i in range(len(texts[k]) - 49):
            first.setdefault(texts[k][i : i + 50], k)
    out = {}
    for k, b in texts.items():
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < k:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[k] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def compared(spark, rows):
    out = substrings.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    expected = brute(rows)
    for r in out:
        if r.doc_id is not None:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected[r.doc_id], r.doc_id


def test_random_overlaps(spark):
    rng = random.Random(1)
    pool = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(30, 160))) for _ in range(25)]
    compared(spark, [(k, "".join(rng.choice(pool) for _ in range(rng.randint(0, 6))) + rng.choice(["", "é" * 40, "x"])) for k in rng.sample(range(1000), 120)])


def test_periodic_texts(spark):
    rng = random.Random(2)
    compared(spark, [(k, (rng.choice(["a", "ab", "abc", "at at "]) * rng.randint(10, 120))[: rng.randint(30, 400)] + rng.choice(["", "end", "a" * 60])) for k in range(60)])


def test_edges_of_fifty(spark):
    base = "".join(random.Random(3).choice("abcdefghij") for _ in range(200))
    rows = [(10, base)] + [(11 + n, "<" + base[40 : 40 + n] + ">") for n in (48, 49, 50, 51)] + [(5, base[:50]), (6, base[:49]), (99, base[100:] + base[:100])]
    compared(spark, rows)


def test_flushes_and_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 500)
    rng = random.Random(4)
    pool = ["".join(rng.choice("abcdefgh ") for _ in range(90)) for _ in range(15)]
    compared(spark, [(k, "".join(rng.choice(pool) for _ in range(4))) for k in range(80)])


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(_store, "NARROW", -1)
    compared(spark, [(k, "shared text that is long enough to be removed as it has more than fifty bytes" + str(k)) for k in range(5)])


def test_odd_rows(spark, odd, odd_rows, empty):
    out = substrings.deduplicated(odd).collect()
    assert len(out) == len(odd_rows)
    expected = brute({(r[0], r[1]) for r in odd_rows})
    for r in out:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected[r.doc_id]
    assert substrings.deduplicated(empty).count() == 0


def brute_rows(rows):
    """The same for rows of which several may have one id: each loses what a smaller id holds."""
    first = {}
    for k, t in sorted(((k, (t or "").encode()) for k, t in rows if k is not None), key=lambda r: r[0]):
        for i in range(len(t) - 49):
            first.setdefault(t[i : i + 50], k)
    for k, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if k is not None and first[b[i : i + 50]] < k:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        yield k, len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest()


def test_texts_that_share_an_id_keep_their_own_bytes(spark, monkeypatch):
    rng = random.Random(8)
    a, b, c = ("".join(rng.choice("abcdefghijklmnop ") for _ in range(n)) for n in (200, 75, 130))
    order = lambda r: tuple(str(x) for x in r)
    for narrow in (_store.NARROW, -1):
        monkeypatch.setattr(_store, "NARROW", narrow)
        for rows in ([(1, a), (2, a), (2, b)], [(1, a), (2, b), (2, a)], [(1, a), (2, a), (2, b), (2, b), (2, a), (3, b + c), (3, c + a), (3, None), (4, c), (4, c[1:]), (None, a), (None, b)], [(7, a), (7, a), (9, a)]):
            out = substrings.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
            assert sorted(map(tuple, out), key=order) == sorted(brute_rows(rows), key=order)


def test_buckets_of_strings_are_refined_from_those_at_later_offsets():
    """Equal identifiers for equal strings only, whichever text and place they stand at."""
    import numpy as np

    from trialspan.llm import _arrays as A

    rng = random.Random(11)
    pool = ["".join(rng.choice("ab") for _ in range(70)) for _ in range(4)] + ["a" * 120]
    seen, ids = {}, set()
    for _ in range(30):
        text = "".join(rng.choice(pool) for _ in range(3)).encode()
        sums = A.prefix(np.frombuffer(text, np.uint8))
        lo, hi = 5, len(text) - substrings.LENGTH + 1
        both = substrings._buckets(sums, lo, hi)
        assert [len(x) for x in both] == [hi - lo] * 2
        for i, pair in zip(range(lo, hi), zip(*(x.tolist() for x in both), strict=True), strict=True):
            assert seen.setdefault(text[i : i + substrings.LENGTH], pair) == pair
            ids.add(pair)
    assert len(ids) == len(seen)
