"""Operators that judge each row by itself."""

import re
from collections import Counter

import numpy as np

from trialspan.llm import _context, licenses, quality, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n, marked = Counter(windows), [False] * len(w)
    for i, g in enumerate(windows):
        if n[g] > 1:
            marked[i] = marked[i + 1] = marked[i + 2] = True
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), again, sum(marked)


def test_quality_base(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(8, 1, 0), (7, 1, None), (3, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    ratios = quality.train(odd, quality.trusted_ids(labels))
    out = quality.rate(odd, ratios).collect()
    assert len(out) == len(odd_rows)
    for r, row in zip(out, odd_rows, strict=True):
        expected = base_counts(row[1])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0]) and not (r.base_failed and r.kept)
    assert quality.rate(empty, ratios).count() == 0
    assert not quality.train(empty, quality.trusted_ids(labels)).any() and not quality.train(odd, quality.trusted_ids(labels.limit(0))).any()


def test_quality_score_is_the_mean_ratio(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b x"), (3, "q")], "doc_id long, text string")
    ratios = np.arange(quality.BUCKETS) / 1000.0
    out = {r.doc_id: r.score for r in quality.rate(docs, ratios).collect()}
    h = {w: licenses.hashed([w])[0] for w in "abcdxq"}
    from trialspan.llm import _arrays as A

    def score(words):
        grams = [h[w] for w in words] + [A.grams(np.array([h[p], h[q]]), 2)[0] for p, q in zip(words, words[1:], strict=False)]
        return sum(int(g >> np.uint64(48)) / 1000.0 for g in grams) / len(grams)

    for k, words in ((1, "abcd"), (2, "abx"), (3, "q")):
        assert abs(out[k] - score(list(words))) < 1e-9


def test_junk_is_told_from_prose(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fit, unseen = quality.halves(quality.trusted_ids(labels))
    ratios = quality.train(docs, fit)
    threshold = quality.calibrated(docs, unseen, ratios)
    out = quality.rate(docs, ratios, threshold).join(labels, "doc_id").where("not base_failed")
    good, poor = out.where("quality = 1"), out.where("quality = 0")
    assert good.where("kept").count() >= 0.99 * good.count() and poor.where("kept").count() <= 0.2 * poor.count()
    assert quality.calibrated(docs, unseen.limit(0), ratios) == quality.THRESHOLD


def test_no_poor_row_passes_the_calibrated_threshold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fit, unseen = quality.halves(quality.trusted_ids(labels))
    ratios = quality.train(docs, fit)
    out = quality.rate(docs, ratios, quality.calibrated(docs, unseen, ratios)).join(labels, "doc_id").where("not base_failed")
    good, poor = out.where("quality = 1"), out.where("quality = 0")
    assert poor.count() >= 20 and poor.where("kept").count() <= 0.02 * poor.count() and good.where("kept").count() >= 0.99 * good.count()


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def test_url_rules(spark):
    cases = ["http://a.COM/en/1", "http://example.com/en/7x", "http://x.example.com/en/712?q", "https://com/en/", "http://notcom/en/", "https://b.net/de/1", "https://a.example.net/de/8#t", "http://org/es/", "http://o.org/esx", None, "", "plain", "x://", "ftp://h?q=/en/", "http://a.com:80/en/", "HTTP://É.com/en/é", "a://b://c.com/en/"]
    pages = spark.createDataFrame([(k, u, "h", 1.0) for k, u in enumerate(cases)] + [(0, cases[0], "h", 1.0)], "page_id long, url string, html string, score double")
    out = urls.judge(pages).collect()
    assert len(out) == len(cases) + 1
    for r in out:
        assert (r.host, r.path) == host_path(cases[r.page_id])
        fits = [(h + p, v) for h, p, v in urls.RULES if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        best = max(fits, key=lambda f: len(f[0]), default=(None, None))
        assert r.rule == best[0] and (best[1] is None or r.verdict == best[1]) and r.verdict in ("allow", "block")
    assert urls.judge(pages.limit(0)).count() == 0


def test_url_model_learns_the_rules(spark):
    pages = spark.createDataFrame([(k, f"http://{'good' if k % 2 else 'evil'}{k}.{'net/de' if k % 2 else 'com/en'}/{k}") for k in range(400)] + [(1000, "http://good7.shop/x"), (1001, "http://evil8.shop/x")], "page_id long, url string")
    out = {r.page_id: r for r in urls.judge(pages).collect()}
    assert out[1000].verdict == "allow" and out[1001].verdict == "block" and out[1000].score > out[1001].score


def test_url_models_in_several_blocks_score_alike(spark, monkeypatch):
    pages = spark.createDataFrame([(k, f"http://{'good' if k % 2 else 'evil'}{k}.{'net/de' if k % 2 else 'com/en'}/{k % 17}x") for k in range(300)] + [(1000 + k, f"http://{x}.shop/{k}") for k, x in enumerate(("good7", "evil8", "other"))], "page_id long, url string")
    judged = lambda: sorted((*r[:5], round(r.score, 4)) for r in urls.judge(pages).collect())
    whole = judged()
    monkeypatch.setattr(_context, "BLOCK_BYTES", 1)
    assert judged() == whole


def test_license_base(odd, odd_rows, empty):
    out = licenses.scan(odd).collect()
    assert len(out) == len(odd_rows)
    for r, row in zip(out, odd_rows, strict=True):
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in row[1] or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        hits = [(i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert r.n_words == len(w) and r.n_base == len(hits)
        assert (r.first_word, r.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert r.base_labels == ",".join(sorted({h[1] for h in hits})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
    assert out[17].labels == "apache,apache-2.0,mit,mit-notice" and out[17].score == 1.0
    assert licenses.scan(empty).count() == 0


def test_template_markup():
    a = licenses.Automaton("copyright [c] {2} all rights [fully] reserved")
    yes = ["copyright all rights reserved", "copyright c x y all rights reserved", "copyright x all rights fully reserved tail", "copyright c all all rights reserved"]
    no = ["copyright x y z all rights reserved", "copyright all right reserved", "c all rights reserved", "copyright", "copyright c x y z all rights reserved"]
    assert all(a.accepts(licenses.hashed(t.split())) for t in yes) and not any(a.accepts(licenses.hashed(t.split())) for t in no)


def test_whole_licence_texts(spark):
    """Mandatory wording must match word for word; optional and replaceable regions may differ."""
    rng = np.random.default_rng(6)

    def filled(template, broken=False):
        out = []
        for x in re.findall(r"\[[^\]]*\]|\{\d+\}|\S+", template):
            if x[0] == "[":
                out += x[1:-1].split() if rng.random() < 0.5 else []
            elif x[0] == "{":
                out += ["Some", "Holder"][: int(x[1:-1])]
            else:
                out.append(x)
        if broken:
            fixed = [k for k, w in enumerate(out) if w.islower() and w.isalpha()]
            out[fixed[len(fixed) // 2]] = "otherwise0"
        return "Intro. " + ", ".join(out).upper() + " and more"

    long = [(t, label) for t, label in licenses.TEMPLATES if len(t.split()) > 30]
    rows = [(2 * k + b, filled(t, bool(b))) for k, (t, _) in enumerate(long) for b in (0, 1)]
    out = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (_, label) in enumerate(long):
        assert label in out[2 * k] and label not in out[2 * k + 1]
    assert "bsd-3-clause" not in out[2] and "bsd-2-clause" not in out[4]
