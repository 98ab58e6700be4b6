import random

import numpy as np
import pyarrow as pa

from trialspan.llm import _arrays as A
from trialspan.llm import paragraphs


def units(text):
    data = np.frombuffer((text or "").encode(), np.uint8)
    _, start, size, _, _ = paragraphs.paragraphs(A.LOWER[data], np.array([0, len(data)]))
    return list(zip(start.tolist(), size.tolist(), strict=True))


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    """Clusters from all pairs of paragraphs: equal words, or Jaccard of at least 0.8 on five-word shingles."""
    found = []
    for k, t in rows:
        w = lowered(t).split()
        for s, n in units(t):
            words = tuple(w[s : s + n])
            found.append((k, s, words, {words[i : i + 5] for i in range(n - 4)}))
    root = list(range(len(found)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(found)):
        for b in range(a):
            x, y = found[a], found[b]
            if x[2] == y[2] or 100 * len(x[3] & y[3]) >= 80 * len(x[3] | y[3]):
                root[find(a)] = find(b)
    groups = {}
    for a, x in enumerate(found):
        groups.setdefault(find(a), []).append(x[:2])
    return {(k, s): min(m)[0] for m in groups.values() if len({k for k, _ in m}) > 1 for k, s in m}


def prose(rng, n):
    return " ".join(f"w{rng.randint(0, 5000)}" for _ in range(n))


def test_matches_brute_force(spark):
    rng = random.Random(1)
    shared = [prose(rng, 60) for _ in range(6)]

    def edited(t):
        w = t.split()
        w[rng.choice([0, 1, len(w) - 1])] = "edit"
        return " ".join(w)

    rows = [(k, "\n".join(rng.choice([prose(rng, 30), rng.choice(shared), edited(rng.choice(shared)), prose(rng, 40) + " " + rng.choice(shared)]) for _ in range(3))) for k in range(60)]
    out = {(r.doc_id, r.first_word): r for r in paragraphs.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = brute(rows)
    assert set(out) == set(expected)
    assert all(out[k].first_doc == expected[k] and out[k].kept == (k[0] == expected[k]) for k in out)


def test_keys_of_many_paragraphs_are_split(spark, monkeypatch):
    """With a bound of three on a key, texts of one template, of chains of edits, and of pairs in them give what all pairs give."""
    rng = random.Random(7)
    template = [f"t{k}" for k in range(30)]
    rows = []
    for k in range(90):
        w = list(template)
        w[29 - k % 12] = f"edit{k}"
        if k % 3 == 0:
            w[: k % 9] = [f"own{k % 4}x{j}" for j in range(k % 9)]
        rows.append((k, " ".join(w)))
    chain = [f"c{k}" for k in range(40)]
    for k in range(90, 120):
        chain[(k - 90) % 40] = f"link{k}"
        rows.append((k, " ".join(chain) + "\n" + prose(rng, 20)))
    rows += rows[:5]
    expected = brute(list(dict(rows).items()))
    seen = []
    deal = paragraphs._of_large_keys
    monkeypatch.setattr(paragraphs, "HOT", 3)
    monkeypatch.setattr(paragraphs, "_of_large_keys", lambda *a: seen.append(1) or deal(*a))
    out = {(r.doc_id, r.first_word): r.first_doc for r in paragraphs.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert seen and out == expected


def test_pasted_passages_are_caught_and_others_left(spark):
    rng = random.Random(2)
    rows, pasted = [], set()
    for k in range(300):
        t = prose(rng, 150).split()
        if k % 3 == 0:
            at = rng.randrange(len(t))
            t[at:at] = ["p" + x for x in prose(random.Random(k // 30), 60).split()]
            pasted.add(k)
        rows.append((k, " ".join(t)))
    found = {r.doc_id for r in paragraphs.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found <= pasted and len(found) >= 0.95 * len(pasted)


def test_paragraphs_do_not_depend_on_what_is_around():
    rng = random.Random(3)
    for _ in range(50):
        p = prose(rng, 80)
        own = {tuple(p.split()[s : s + n]) for s, n in units(p)}
        t = prose(rng, 50) + " " + p + " " + prose(rng, 50)
        there = {tuple(t.split()[s : s + n]) for s, n in units(t)}
        assert len(own & there) >= len(own) - 4


def test_equal_and_nearly_equal_lines_among_other_lines(spark):
    rng = random.Random(4)
    rows, at = [], {}
    for k in range(80):
        line = [f"q{k}x{i}" for i in range([7, 8, 10, 15, 60][k % 5])]
        for half in (0, 1):
            before = prose(rng, rng.randint(8, 20))
            if half and len(line) == 60:
                line[20] = "edit"
            rows.append((2 * k + half, before + "\n" + " ".join(line) + "\n" + prose(rng, 12)))
            at[2 * k + half] = len(before.split()), len(line)
    out = {(r.doc_id, r.first_word, r.n_words) for r in paragraphs.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(k, *w) for k, w in at.items()} <= out


def test_passages_in_short_lines(spark):
    rng = random.Random(5)
    items = [f"a{k} b{k} c{k}" + f" d{k}" * (k % 4) for k in range(30)]
    head = "one short head"
    rows = []
    for k in (0, 1):
        rows.append((k, "\n".join([prose(rng, 20), f"x{k} y{k}", *items, f"z{k}", prose(rng, 20)])))
        rows.append((k + 2, "\n".join([prose(rng, 20), head, " ".join(f"r{i}" for i in range(9)), prose(rng, 20)])))
    words = {k: set() for k, _ in rows}
    for r in paragraphs.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        words[r.doc_id] |= set(rows[[k for k, _ in rows].index(r.doc_id)][1].split()[r.first_word : r.first_word + r.n_words])
    listed = set(" ".join(items).split())
    assert all(len(words[k] & listed) >= 0.8 * len(listed) and words[k] <= listed | {f"x{k}", f"y{k}", f"z{k}"} for k in (0, 1))
    assert all(words[k] >= set(head.split()) for k in (2, 3))


def test_every_place_of_a_linked_class(spark):
    rng = random.Random(6)
    line = [f"q{i}" for i in range(60)]
    edited = " ".join([*line[:20], "edit", *line[21:]])
    rows = [(1, " ".join(line)), (2, "\n".join([prose(rng, 20), edited, prose(rng, 20), edited]))]
    out = {(r.doc_id, r.first_word) for r in paragraphs.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.n_words == 60}
    assert out == {(1, 0), (2, 20), (2, 100)}


def test_odd_rows(odd, odd_rows, empty):
    out = paragraphs.repeated(odd).collect()
    rows = sorted({(r[0], r[1]) for r in odd_rows if r[0] is not None and r[1]})
    expected = brute([r for r in rows if len(r[1]) < 50000])
    assert {(r.doc_id, r.first_word): r.first_doc for r in out} == expected
    assert paragraphs.repeated(empty).count() == 0


def test_keys_of_the_same_paragraphs_are_one():
    """Pairs that collide in several bands are handed on once, and where a third paragraph is in one band only, all are."""
    rng = random.Random(8)
    rows = []
    for _ in range(40):
        line = prose(rng, 60).split()
        for edit in ("edit", "other", "third")[: rng.randint(2, 3)]:
            line[rng.randrange(60)] = edit
            rows.append(" ".join(line))
    packed = pa.Table.from_batches(paragraphs._made(4)([pa.RecordBatch.from_pydict({"id": range(len(rows)), "text": rows})])).sort_by("bucket")
    found = [r for b in paragraphs._collided(paragraphs.HOT)(packed.to_batches()) for r in b.to_pylist() if r["kind"] == 1]
    groups, band = {}, {}
    for r in found:
        groups.setdefault(r["key"], set()).add(r["name"])
        band[r["key"], r["name"]] = band.get((r["key"], r["name"]), 0) + 1
    assert max(band.values()) > 1  # several bands
    assert len({frozenset(g) for g in groups.values()}) == len(groups)
    assert all(len(g) > 1 for g in groups.values())


def test_links_do_not_depend_on_batches():
    rng = random.Random(9)
    rows = []
    for key in range(30):
        base = rng.sample(range(1000), 40)
        for k in range(rng.choice([1, 2, 2, 3, 9])):
            s = sorted(set(base[: rng.randint(30, 40)]) | set(rng.sample(range(1000, 2000), rng.randint(0, 5))))
            rows.append({"key": key, "name": 100 * key + k, "shingles": np.array(s, np.uint64).tobytes()})

    def parts(links):
        root = {r["name"]: r["name"] for r in rows}
        for a, b in links:
            x, y = root[a], root[b]
            root = {n: x if r == y else r for n, r in root.items()}
        groups = {}
        for n, r in root.items():
            groups.setdefault(r, set()).add(n)
        return {frozenset(g) for g in groups.values()}

    sets = {r["name"]: np.frombuffer(r["shingles"], np.uint64) for r in rows}
    expected = parts([(a, b) for a in sets for b in sets if a < b and a // 100 == b // 100 and paragraphs._similar(sets[a], sets[b])])
    table = pa.Table.from_pylist(rows, pa.schema([("key", pa.int64()), ("name", pa.int64()), ("shingles", pa.binary())]))
    for n in (1, 2, 3, 7, len(rows)):
        out = pa.Table.from_batches(paragraphs._linked(iter(table.to_batches(max_chunksize=n)))).to_pylist()
        assert parts([(r["a"], r["b"]) for r in out]) == expected
