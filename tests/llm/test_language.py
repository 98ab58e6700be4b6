import functools
import random

import numpy as np
import pytest

from trialspan.llm import _context, language
from trialspan.llm._arrays import LOWER


def brute_bits(texts, text, order=_context.ORDER):
    """Code length of text under a context tree built and searched in plain Python."""
    seen = {}
    coded = lambda t: [0] * order + [int(LOWER[b]) for b in t.encode()]
    for t in texts:
        c = coded(t)
        for i in range(order, len(c)):
            for k in range(order + 1):
                seen.setdefault(tuple(c[i - k : i]), {}).setdefault(c[i], 0)
                seen[tuple(c[i - k : i])][c[i]] += 1

    @functools.cache
    def p(ctx):
        lower = p(ctx[1:]) if ctx else [1 / 256] * 256
        if ctx not in seen:
            return lower
        n = seen[ctx]
        total, kinds = sum(n.values()), len(n)
        rest = sum(lower[y] for y in range(256) if y not in n)
        return [n[x] / (total + kinds) if x in n else kinds / (total + kinds) * lower[x] / rest for x in range(256)]

    c = coded(text)
    return -sum(np.log2(p(tuple(c[i - order : i]))[c[i]]) for i in range(order, len(c)))


def scored(models, texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    return np.concatenate([m.summed(_context.packed(data, off, LOWER), off) for m in models], 1)


def test_code_lengths_are_exact(spark, monkeypatch):
    rng = random.Random(1)
    texts = {x: ["".join(rng.choice(abc) for _ in range(60)) for _ in range(5)] for x, abc in (("x", "aab cdé"), ("y", "abbя ж中"), ("z", "az"))}
    rows = spark.createDataFrame([(x, t) for x, ts in texts.items() for t in ts], "label string, text string")
    asked = ["abc", "zz éé 1", "a", "", "жяя中中a", "QAB ж\x00", "\U0001f600"]
    for bound in (_context.BLOCK_BYTES, 1):
        monkeypatch.setattr(_context, "BLOCK_BYTES", bound)
        models = _context.fit(rows, LOWER)
        assert [n for m in models for n in m.names] == ["x", "y", "z"] and len(models) == (1 if bound > 1 else 3)
        got = scored(models, asked)
        for i, t in enumerate(asked):
            for j, x in enumerate("xyz"):
                assert got[i, j] == pytest.approx(brute_bits(texts[x], t), rel=1e-5, abs=1e-6)


def test_many_languages_keep_the_order(spark):
    """However many labels there are, texts are told apart by contexts of full length, also in other scripts."""
    rng = random.Random(3)
    rows = [(f"l{k:02d}", "".join(chr(0x400 + 3 * k + rng.choice([0, 1, 2])) for _ in range(80))) for k in range(40)]
    rows += [("aab", "aab" * 40), ("aba", "abaabb" * 20)]
    docs = spark.createDataFrame([(k, t, x) for k, (x, t) in enumerate(rows)], "doc_id long, text string, lang string")
    models = language.train(docs)
    assert all(len(m.tables) == _context.ORDER + 1 for m in models)
    out = language.identify(docs, models, ["doc_id", "lang"]).collect()
    assert all(r.lang == r.lang_pred for r in out)


def test_blocks_of_models_agree(spark, odd, monkeypatch):
    whole = language.identify(odd, language.train(odd), ["doc_id"]).collect()
    monkeypatch.setattr(_context, "BLOCK_BYTES", 1)
    split = language.train(odd)
    assert len(split) == 2
    for a, b in zip(whole, language.identify(odd, split, ["doc_id"]).collect(), strict=True):
        assert (a.doc_id, a.lang_pred) == (b.doc_id, b.lang_pred) and a.score == pytest.approx(b.score) and a.bits_per_byte == pytest.approx(b.bits_per_byte)


def test_what_no_model_codes_is_rejected(spark):
    docs = spark.createDataFrame([(k, "some words of plain text " * 9, "en", 1, 0.5) for k in range(5)] + [(9, "漢字仮名交文" * 20, None, 2, 0.1)], "doc_id long, text string, lang string, `a.b` long, score double")
    out = language.known(docs, language.train(docs))
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == set(range(5))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs.where(~language.held_out()))
    out = language.identify(docs.where(language.held_out()), model, ["doc_id", "lang"])
    assert out.where("lang = lang_pred").count() >= 0.98 * out.count()


def test_odd_rows(odd, empty):
    model = language.train(odd)
    assert [n for m in model for n in m.names] == ["en", "fr"]
    out = language.identify(odd, model, ["doc_id"]).collect()
    assert len(out) == odd.count()
    by = {r.doc_id: r for r in out}
    assert [by[k].lang_pred for k in (0, 1, 2, 5)] == ["und"] * 4 and by[0].score == 0.0
    assert all(0 <= r.score <= 1 for r in out) and by[3].lang_pred in ("en", "fr")
    none = language.train(empty)
    assert none == [] and {r.lang_pred for r in language.identify(odd, none, ["doc_id"]).collect()} == {"und"}
    assert language.identify(empty, model, ["doc_id"]).count() == 0
    kept = language.known(odd, model)
    assert kept.columns == odd.columns and kept.where("text is null or text = ''").count() == 0
    assert {7, 8, 9, 10, 11, 12, 13, 14, 15, 21, 22} <= {r.doc_id for r in kept.collect()}


def test_many_languages_of_disjoint_contexts_stay_within_the_bound(spark, monkeypatch):
    """20 languages with 100,000 contexts of their own each: blocks are bounded by contexts times languages, and building them needs little more."""
    import tracemalloc

    import numpy as np
    from pyspark.sql import functions as F

    from trialspan.llm import _context

    rng = np.random.default_rng(5)
    sizes, built = [], _context.Models.__init__

    def spied(self, names, *arrays):
        built(self, names, *arrays)
        sizes.append((len(names), sum(t[1].nbytes + t[3].nbytes for t in self.tables)))

    monkeypatch.setattr(_context.Models, "__init__", spied)
    words = ["".join(map(chr, rng.integers(33, 127, 33_400))) for _ in range(20)]
    docs = spark.createDataFrame([(f"l{k:02}", words[k][i : i + 3340]) for k in range(20) for i in range(0, 33_400, 3340)], "label string, text string").withColumn("text", F.concat(*(F.translate("text", "abcdefgh", x) for x in ("ABCDEFGH", "12345678", "hgfedcba"))))
    tracemalloc.start()
    models = _context.fit(docs, np.arange(256, dtype=np.uint8))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(n for n, _ in sizes) == 20 and len(models) > 1 and all(b <= 2 * _context.BLOCK_BYTES for _, b in sizes)
    assert peak < 300 << 20
