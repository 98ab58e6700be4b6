import random
import resource

import numpy as np

from trialspan.llm import decontaminate as D


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def distance(window, text):
    """Least edits between window and any part of text."""
    text, ramp = np.frombuffer(text, np.uint8), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, c in enumerate(window, 1):
        new = np.minimum(row + 1, np.concatenate(([i], row[:-1] + (text != c))))
        row = np.minimum.accumulate(new - ramp) + ramp
    return row.min()


def folded(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    return bytes(0x20 if b in (0x20, 9, 10, 11, 12, 13) else b for b in t)


def windows(text):
    """(bytes, edits allowed) of all windows of an item."""
    t = folded(text)
    for length, step, share in D.WINDOWS if len(t) >= D.Q else ():
        last = max(0, len(t) - length)
        for s in {*range(0, last + 1, step), last}:
            w = t[s : s + length]
            yield w, min(len(w) // share, max((len(w) - D.Q) // D.Q, 0))


def brute(docs, items):
    return {(k, item) for k, t in docs for item, text in items if t and any(distance(w, folded(t)) <= e for w, e in windows(text))}


def edited(rng, t, n):
    t = list(t)
    for _ in range(n):
        at = rng.randrange(len(t))
        match rng.randrange(3):
            case 0:
                t[at] = "#"
            case 1:
                t.insert(at, "#")
            case _:
                del t[at]
    return "".join(t)


def test_matches_brute_force(spark):
    rng = random.Random(1)
    items = [(k, prose(rng, rng.randint(4, 30))) for k in range(8)] + [(90, "short"), (91, None)]
    docs = []
    for k in range(60):
        part = rng.choice(items[:8])[1]
        cut = rng.randint(0, len(part) // 2)
        docs.append((k, prose(rng, 15) + " " + edited(rng, part[cut : cut + rng.randint(40, 160)], rng.randint(0, 9)) + " " + prose(rng, 10)))
    docs += [(100, items[0][1].upper().replace(" ", "\n")), (101, prose(rng, 40)), (102, None), (103, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    expected = brute(docs, items)
    assert got == expected and (100, 0) in got and len({d for d, _ in got}) > 10


def test_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(2)
    items = [(k, prose(rng, 20)) for k in range(12)]
    docs = spark.createDataFrame([(k, prose(rng, 10) + " " + items[k % 12][1]) for k in range(24)] + [(99, prose(rng, 30))], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, D.contaminated(docs, bench).collect()))
    monkeypatch.setattr(D, "BLOCK_BYTES", 500)
    assert sorted(map(tuple, D.contaminated(docs, bench).collect())) == one
    assert [r.doc_id for r in D.clean(docs, bench).collect()] == [99]


def test_odd_rows(spark, odd, odd_rows, empty):
    passage = odd_rows[12][1]
    bench = spark.createDataFrame([(7, passage), (8, None), (9, "")], "item_id long, text string")
    out = D.contaminated(odd, bench).collect()
    assert sorted({r.doc_id for r in out}) == [12, 13, 14] and all(r.contaminated and r.item_id == 7 for r in out)
    kept = D.clean(odd, bench)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows) - 3
    assert D.contaminated(empty, bench).count() == 0 and D.contaminated(odd, bench.limit(0)).count() == 0 and D.clean(odd, bench.limit(0)).count() == len(odd_rows)


def test_unchanged_quotations_of_87_bytes(spark):
    rng = random.Random(8)
    item = prose(rng, 60)
    docs = [(k, prose(rng, 20) + " " + item[3 * k : 3 * k + 87] + " " + prose(rng, 20)) for k in range(80)]
    found = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r.doc_id for r in found.collect()} == set(range(80))


def test_a_long_run_of_one_character_is_bounded():
    """10 MB of one character, or of a short period, against items that hold such runs, in little memory."""
    index = D.Index([(1, "a question" + " " * 300 + "and more"), (2, "ab" * 100), (3, "plain words that stand here and nowhere else in the texts")])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for text, expected in ((b" " * 10_000_000, {1}), (b"x" + b"ab" * 3_000_000 + b" " * 3_000_000, {1, 2}), (b"plain words that stand here and nowhere else in the texts" + b"z" * 100_000, {3})):
        _, window, _ = index.search(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert {int(index.item[w]) for w in window} == expected
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 2 << 20


def test_thinned_repeats_change_nothing(monkeypatch):
    rng = random.Random(12)
    index = D.Index([(1, "x" * 150), (2, "ab" * 70), (3, "abc" * 50 + prose(rng, 20))])
    texts = ["x" * rng.randint(50, 3000) + rng.choice(["ab", "abc", "y"]) * rng.randint(1, 1500) + prose(rng, 5) for _ in range(10)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    whole = index.search(data, off)
    monkeypatch.setattr(D, "CHUNK", 1000)
    thin = index.search(data, off)
    assert {(d, w) for d, w, _ in zip(*whole, strict=True)} == {(d, w) for d, w, _ in zip(*thin, strict=True)} and len(whole[0])


def test_dotted_names(spark):
    docs = spark.createDataFrame([(1, "some text", 1), (2, None, 2)], "doc_id long, text string, `a.b` long")
    out = D.clean(docs, spark.createDataFrame([(1, "an item that is not there at all")], "item_id long, text string"))
    assert out.columns == docs.columns and out.count() == 2


def test_a_stem_that_many_items_share_is_searched_in_bounded_memory():
    import time
    import tracemalloc

    rng = random.Random(12)
    stem = prose(rng, 40)[:110]
    items = [(k, stem + prose(rng, 12)[:60]) for k in range(20_000)]
    index = D.Index(items)
    text = stem + items[77][1][110:160] + " x"
    data = D._FOLD[np.frombuffer(text.encode(), np.uint8)]
    tracemalloc.start()
    began = time.perf_counter()
    _, window, _ = index.search(data, np.array([0, len(data)]))
    took, peak = time.perf_counter() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    found = index.item[window]
    assert 77 in found and len(set(found.tolist())) == 20_000  # all of them hold whole windows of the stem
    assert peak < 500 << 20 and took < 30
    whole = [(k, w) for k in (5, 77) for w in np.flatnonzero(index.item == k).tolist() if distance(index.data[index.start[w] : index.start[w] + index.size[w]].tobytes(), data.tobytes()) <= index.edits[w]]
    assert {w for _, w in whole} == {w for w in window.tolist() if index.item[w] in (5, 77)}
