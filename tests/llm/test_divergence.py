"""The audit of sources against whole vocabularies in plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from trialspan.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(rows, least, top):
    docs, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source, found = lang or "", source or "", terms(text)
        groups[lang].add(source)
        docs[lang].update(set(found))
        n[lang, source].update(found)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, d in docs[lang].items() if d >= least]

        def shares(count):
            total = sum(count[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 2) // total for t in kept}

        far = lambda p, q: (p - q) ** 2 // (p + q)
        whole = shares(sum((n[lang, s] for s in sources), Counter()))
        own = {s: shares(n[lang, s]) for s in sources}
        for s in sources:
            pairs = [(o, sum(far(own[s][t], own[o][t]) for t in kept)) for o in sources - {s}]
            telling = [(t, far(own[s][t], whole[t])) for t in kept if n[lang, s][t] and own[s][t] > whole[t]]
            for part, items, most in (("pair", pairs, None), ("term", telling, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def check(spark, rows, least=3, top=4):
    got = divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string").repartition(3), least=least, top=top)
    assert sorted(map(tuple, got.collect())) == expected(rows, least, top)


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcéß") for _ in range(rng.randint(1, 3))) for _ in range(120)] + ["İ", "x-y", "don't", "ABC", "Abc", "\U0001f600", "１２"]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "de", None, ""]), rng.choice(["hot", "hot", "hot", "s1", "s2", None, "é", "z"])
        rows.append((" ".join(rng.choice(words[rng.randrange(60) :]) for _ in range(rng.randint(0, 20))), lang, source))
    return rows


def test_against_whole_vocabularies(spark):
    check(spark, corpus())
    check(spark, corpus(80, 9), least=1)


def test_sources_without_terms_and_languages_without_kept_terms(spark):
    rows = [("a b", "en", "s"), ("a b", "en", "s"), ("a", "en", "t"), (None, "en", "u"), ("12", "en", "v"), ("only once", "fr", "s"), ("other", "fr", "t"), ("a a a", "it", "s"), ("", "pt", None)]
    check(spark, rows)
    check(spark, rows * 3, least=3)


def test_a_full_sketch_rules_nothing_out_wrongly(spark, monkeypatch):
    monkeypatch.setattr(divergence, "_reached", lambda sketch: np.full(divergence.ROWS * divergence.WIDTH // 8, 255, np.uint8))
    check(spark, corpus(300, 5))


def test_the_sketch_never_tells_less_and_rules_out_most(spark):
    rows = [(f"common word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}q", "en", "s") for k in range(600)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    found = {r.term: r.docs for r in divergence.counted(df, least=5).collect()}
    assert found == {"common": 600}
    seen = lambda least: int(np.unpackbits(divergence._reached(divergence.sketched(df.select("lang", "text").repartition(3), least))).sum())
    assert seen(600) == seen(2) == 4 and 4 * 590 < seen(1) <= 4 * 601 and seen(601) == 0


def test_odd_rows(spark, odd, odd_rows, empty):
    got = divergence.audit(odd, least=2, top=10)
    assert sorted(map(tuple, got.collect())) == expected([r[1:4] for r in odd_rows], 2, 10)
    assert divergence.audit(empty).count() == 0
