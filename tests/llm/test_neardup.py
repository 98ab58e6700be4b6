import random

import numpy as np

from trialspan.llm import neardup
from trialspan.llm._components import components


def shingles(text, n=5):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    w = [x for x in t.split(" ") if x]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, percent):
    sets = {k: shingles(t) for k, t in rows if k is not None}
    least = {k: k for k in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            if (least[a], least[b]) != (m, m):
                least[a] = least[b] = m
                changed = True
    return least


def family(n, seed, edits):
    """Copies of one text with a few words changed: many pairs stand near the threshold."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(140)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"z{rng.randint(0, 9999)}"
        out.append(" ".join(w))
    return out


def test_families_match_brute_force(spark):
    rows = list(enumerate(family(60, 1, 6) + family(40, 2, 4) + family(30, 3, 12)))
    rows += [(k + 1000, t) for k, t in rows[:20]]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in out} == brute(rows, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_blocks_of_a_family(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 1000)
    rows = list(enumerate(family(60, 4, 6)))
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in out} == brute(rows, 85)


def test_odd_rows(odd, odd_rows, empty):
    out = neardup.near_duplicates(odd).collect()
    assert len(out) == len(odd_rows)
    expected = brute({(r[0], r[1]) for r in odd_rows}, 85)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == expected[r.doc_id] and r.n_shingles == len(shingles(odd_rows[r.doc_id][1]))
    assert neardup.near_duplicates(empty).count() == 0
    kept = neardup.survivors(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and set(ids) == {k for k, c in brute({(r[0], r[1]) for r in odd_rows}, 80).items() if k == c}


def test_every_coordinate_fills_and_estimates():
    rng = np.random.default_rng(0)
    for n in (1, 3, 40, 2000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        assert np.array_equal(neardup.sketch(np.unique(a)), neardup.sketch(np.unique(a[::-1])))
    shared, x, y = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (800, 100, 100))
    both = [(neardup.sketch(np.unique(np.concatenate((shared, x)))) == neardup.sketch(np.unique(np.concatenate((shared, y))))).mean()]
    assert abs(both[0] - 0.8) < 0.15


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {k: 0 for k in range(51)} | {k: 100 for k in range(100, 160)}


def test_texts_of_one_id_belong_together(spark):
    one, two, three = (" ".join(f"{p}{k}" for k in range(60)) for p in "xyz")
    rows = [(1, one), (2, two), (2, one), (3, two), (4, three), (4, three + " more"), (5, None), (5, three), (6, three)]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == [(1, 1), (2, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 4), (5, 5), (6, 4)]  # no words, no links
    kept = {r.doc_id: r.text for r in neardup.survivors(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {1: one, 4: three}


def test_a_large_part_meets_small_ones_only(spark, monkeypatch):
    """Blocks of one part are not paired, and no link between parts is lost however blocks are dealt."""
    monkeypatch.setattr(neardup, "BLOCK", 600)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 4)
    rows = list(enumerate(family(70, 9, 7) + family(50, 10, 9)))
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in out} == brute(rows, 85)
    parts = spark.createDataFrame([(7, k, k, 1, 0 if k < 40 else k, 1) for k in range(45)], "g long, id long, one long, n long, part long, x long")
    pairs = neardup._block_pairs(parts, "g", neardup.F.lit(1), 10).collect()
    met = {(a.id, b.id) for a in pairs for b in pairs if a.id < b.id and (a.p, a.q) == (b.p, b.q) and {a.block, b.block} == {a.p, a.q}}
    assert {(a, b) for a in range(45) for b in range(40, 45) if a < b} <= met and len(pairs) <= 40 + 5 * 10


def test_recall_of_edits_spread_through_texts(spark):
    """Of pairs at 85 percent or more, by all pairs, at least 0.99 end in one component."""
    rng, rows = random.Random(21), []
    for k in range(120):
        w = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(30, 400))]
        other = [x if rng.random() > 0.015 else f"z{rng.randint(0, 5000)}" for x in w]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
    sets = {k: shingles(t) for k, t in rows}
    pairs = [(a, a + 1) for a in range(0, 240, 2) if 100 * len(sets[a] & sets[a + 1]) >= 85 * len(sets[a] | sets[a + 1])]
    part = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(pairs) > 40 and sum(part[a] == part[b] for a, b in pairs) >= 0.99 * len(pairs)


def test_clashing_and_dotted_names(spark):
    rows = [(1, "a b c d e f", 1, 2, "x"), (2, "a b c d e f", 3, 4, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id long, `a.b` long, ROW string")
    kept = neardup.survivors(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [rows[0]]
