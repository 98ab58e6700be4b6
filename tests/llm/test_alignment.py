"""Composed segments against whole texts tokenised and aligned in plain Python."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trialspan.llm import alignment, queries


@pytest.fixture(scope="module")
def both():
    return alignment.Pair(alignment.BYTE_BPE, alignment.PIECE_BPE)


def whole(both, text):
    """(A ids, B ids, groups, links) of a text by the definition, or None."""
    if not text:
        return None
    a, b = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
    full = (" " + text).encode()
    if b"".join(both.a_bytes[k] for k in a) != full or b"".join(both.b_bytes[k] for k in b) != full:
        return None

    def spans(ids, tokens):
        at, out = 0, []
        for k in ids:
            out.append((at, at + len(tokens[k]), k))
            at += len(tokens[k])
        return out

    sa, sb = spans(a, both.a_bytes), spans(b, both.b_bytes)
    links, j = [], 0
    for lo, hi, k in sa:
        while sb[j][1] <= lo:
            j += 1
        m = j
        while m < len(sb) and sb[m][0] < hi:
            links.append((k, sb[m][2]))
            m += 1
    cuts = sorted({s[1] for s in sa} & {s[1] for s in sb})
    of = lambda spans: [[k for _, _, k in g] for _, g in groupby(spans, key=lambda s: bisect_left(cuts, s[1]))]
    groups = [",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in zip(of(sa), of(sb), strict=True)]
    return a, b, groups, links


def expected(both, texts):
    found = [whole(both, t) for t in texts]
    docs = Counter(p for f in found if f for p in set(f[3]))
    most = defaultdict(int)
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    for f in found:
        if f is None:
            yield 0, 0, 0, 0, 0, 0, ""
        else:
            a, b, groups, links = f
            yield len(a), len(b), len(groups), len(links), sum(docs[p] == most[p[0]] for p in links), sum(docs[p] for p in links), ";".join(groups)


ODD = [
    " ", "  ", " a", "a ", "a  ", "\n", "a \n b", "don't  they'll", "x  y  z", "a  b", "　 c d", "é à b", "price: € 5 , 6", "<s> </s> <|endoftext|> <0x41> <unk>",
    "▁mid", "own ▁ mark", "\U0001f600 \U0001f468‍\U0001f469 zwj", "tab\t x\r\n y\x1c z\x85 w", "1234567 89,10.5", "日本語 テキスト", "\x00 nul \x00", "a" * 500 + " b", "the the the the",
]


def test_against_whole_texts(spark, both, odd, odd_rows):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("ab \n\t.'é 1") for _ in range(rng.randint(1, 60))) for _ in range(150)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(0, texts[0]), (5, "other text"), (None, "the end"), (None, None)]
    out = alignment.aligned(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = Counter((i, *e) for (i, t), e in zip(rows, expected(both, [t for _, t in rows]), strict=True))
    assert Counter(map(tuple, out)) == want
    got = alignment.aligned(odd).collect()
    want = Counter((r[0], *e) for r, e in zip(odd_rows, expected(both, [r[1] for r in odd_rows]), strict=True))
    assert Counter(map(tuple, got)) == want


def test_small_blocks_change_nothing(spark, monkeypatch, both):
    texts = [f"word{k % 7} and {k} more été {k % 3}" for k in range(60)] + [None, "", "▁ own", "▁ own more"]
    monkeypatch.setattr(alignment, "SLICE", 64)  # reaches the workers with the function
    monkeypatch.setattr(alignment, "BUCKET_BYTES", 100)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    blocks = alignment.blocked(docs, 9, "doc_id", "text").collect()
    assert len(blocks) > 20 and sum(len(b.ids) for b in blocks) == len(texts) and {p.bucket for b in blocks for p in b.packed} == set(range(9))
    for pairs in (alignment.PAIRS, 3):  # counts broadcast, and joined to the pairs of each block
        monkeypatch.setattr(alignment, "PAIRS", pairs)
        assert sorted(map(tuple, alignment.aligned(docs).collect())) == [(k, *e) for k, e in enumerate(expected(both, texts))]


def test_given_table(spark, both, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    out = sorted(map(tuple, queries.op11_token_alignment(spark, sf).collect()))
    for r, got, e in zip(rows, out, expected(both, [r.text for r in rows]), strict=True):
        assert got == (r.doc_id, *e[:-1], hashlib.sha256(e[-1].encode()).hexdigest() if e[0] else "")


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\ta1.'é  　 x"), st.characters(codec="utf-8")), min_size=1, max_size=40))
def test_tokens_of_a_text_are_those_of_its_segments(both, text):
    data = np.frombuffer(text.encode(), np.uint8)
    full, bounds, many = alignment.segmented(data, np.array([0, len(data)]))
    assert many.tolist() == [len(bounds) - 1] and full.tobytes() == b" " + text.encode()
    parts = [full[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
    a, b = both.encoded(parts)
    if whole(both, text) is None:
        assert [] in a and [] in b
        return
    assert sum(a, []) == both.a.encode(" " + text, add_special_tokens=False).ids
    assert sum(b, []) == both.b.encode(text)


def test_a_vocabulary_that_reaches_across_is_refused():
    assert len(alignment.breaks(np.frombuffer(b"a b", np.uint8))) == 1
    assert not len(alignment.breaks(np.frombuffer("  b\n c  d".replace("c  d", "c").encode(), np.uint8)))


def test_empty(spark, empty):
    assert alignment.aligned(empty).count() == 0
