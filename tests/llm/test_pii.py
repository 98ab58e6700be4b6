import hashlib
import math
import random
import re

from trialspan.llm import pii

PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    return {"email": True, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def base(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN for m in re.finditer(p, text or "") if valid(k, m.group(0))]


def checked(spark, texts):
    rows = [(k, t) for k, t in enumerate(texts)]
    out = {r.doc_id: r for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(out) == len(rows)
    for k, t in rows:
        spans = base(t)
        assert out[k].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), t
        own = out[k].spans.split(",") if out[k].spans else []
        assert own[: len(spans)] == spans and all(s.startswith("id:") for s in own[len(spans) :])
    return out


def test_hard_texts(spark):
    checked(spark, [
        "a@b.c_x@y.z", "x.@@a@b.cd.@e.f", "a@b@c.de", ".@c.d a@b.com.@c.d", "%+-@a-b.c-d.", "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.004 01.02.03.255x", "1..2.3.4", "999.1.2.3.4",
        "4111 1111 1111 1111", "4111-1111-1111-1111 2", "4111111111111111", "4111  1111 1111 1111", "0000000000000000", "1234567890123456789012", "+1 (555) 010-9999.", "+1+1 5550109999", "+12345678901234567", "+1 ) ", "é+1 23 45 67 89é a@é.b",
        "\U0001f600 a@b.co \U0001f600 10.0.0.1", None, "", "@", "+", "a@b", "a@b.", "a@.b",
    ])


def test_random_texts(spark):
    rng = random.Random(7)
    checked(spark, ["".join(rng.choice("ab1209.@+-() _%é\n") for _ in range(rng.randint(0, 60))) for _ in range(1500)])


def test_long_runs_are_linear(spark):
    checked(spark, ["a" * 100000, "1." * 30000, "1 " * 50000, "+" * 50000, "a@b" + ".c" * 30000, "+1" + " " * 50000])


def test_context_discovers_unseen_identifiers(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta"])
    token = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(18))
    texts = [f"{word()} contact {word()}{k}@example.org today {word()}" for k in range(40)]
    texts += [f"{word()} contact {token()} today" for _ in range(5)] + [f"{word()} contact password={token()} today" for _ in range(5)] + [f"odd{k} password={token()} rare{k}" for k in range(5)]
    texts += [f"{word()} version 2024-01-0{k + 1} released build{k}x99 now" for k in range(5)]
    out = checked(spark, texts)
    assert all(out[k].n_id == 1 for k in range(40, 55)) and all(out[k].n_id == 0 for k in range(55, 60))


def test_masking(spark):
    rows = [(1, "mail a@b.org now", "x"), (2, None, "y"), (3, "none", "z"), (None, "ip 10.0.0.1", "n"), (4, "x 4111 1111 1111 1111 é a@b.org", "w")]
    out = {r.doc_id: r for r in pii.masked(spark.createDataFrame(rows, "doc_id long, text string, start string")).collect()}
    assert out[1].text == "mail [EMAIL] now" and out[2].text is None and out[3].text == "none" and out[1].start == "x"
    assert "4111" not in out[4].text and out[4].text.endswith("é [EMAIL]") and len(out) == 5


def test_masking_needs_no_id_of_its_own(spark):
    rows = [(None, "ip 10.0.0.1 or a@b.org", "n"), (None, "call +1 (555) 010-9999", "o"), (5, "mail a@b.org now", "p"), (5, "now a card 4111 1111 1111 1111", "q"), (5, None, "r")]
    out = {r.email: r.text for r in pii.masked(spark.createDataFrame(rows, "doc_id long, text string, email string")).collect()}
    assert out == {"n": "ip [IP] or [EMAIL]", "o": "call [PHONE]", "p": "mail [EMAIL] now", "q": "now a card [CARD]", "r": None}


def test_masking_by_row(spark):
    """Ids that are missing or repeat, and names that clash with the operator's own, change no other row's text."""
    rows = [(1, "long a@b.org before e@f.org x", 1, 2, 3), (1, "ip 10.0.0.1", 1, 2, 3), (None, "mail a@b.org now", 1, 2, 3), (None, None, 1, 2, 3), (1, "plain", 4, 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id long, key long, `a.b` long")
    out = pii.masked(docs)
    assert out.columns == docs.columns
    assert sorted(map(str, (r[1] for r in out.collect()))) == sorted(["long [EMAIL] before [EMAIL] x", "ip [IP]", "mail [EMAIL] now", "None", "plain"])
    assert {(r[0], r[2], r[3], r[4]) for r in out.collect()} == {(1, 1, 2, 3), (None, 1, 2, 3), (1, 4, 5, 6)}


def test_no_base_match_is_left(spark):
    rng = random.Random(11)
    pieces = ["a@b.org", "10.0.0.1", "4111 1111 1111 1111", "+1 (555) 010-9999", "plain", "é", "x=7", "\n", "token = 9f8e7d6c5b4a"]
    rows = [(rng.choice([None, 1, 2, k]), " ".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))) for k in range(300)]
    out = pii.masked(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.count() == 300 and not any(base(r.text) for r in out.collect())


def brute_ids(occurrences):
    """The accepted instances, by the rule in plain Python: occurrences are (instance, fixed, patterns)."""
    edges, fixed = {(i, p) for i, _, ps in occurrences for p in ps}, {i: f for i, f, _ in occurrences}
    score, states = {}, []
    while True:
        at = {i: fixed[i] if fixed[i] is not None else score.get(i, 0.0) for i in fixed}
        doubt = {}
        for p in {p for _, p in edges}:
            mine = [i for i, q in edges if q == p]
            good = [at[i] for i in mine if at[i] >= pii.INSTANCE_SCORE]
            bad = sum(1.0 if fixed[i] == 0.0 else pii.UNJUDGED for i in mine if at[i] < pii.INSTANCE_SCORE)
            sure = sum(good) / (sum(good) + bad + pii.DOUBT)
            if sure >= pii.PATTERN_CONFIDENCE and len(good) >= pii.PATTERN_SUPPORT:
                doubt[p] = math.log(max(1 - sure, 1e-9))
        score = {i: 1 - math.exp(sum(doubt[p] for j, p in edges if j == i and p in doubt)) for i in fixed if fixed[i] is None and any(j == i and p in doubt for j, p in edges)}
        accepted = frozenset(i for i, v in score.items() if v >= pii.INSTANCE_SCORE)
        if accepted in states or not accepted:
            return accepted
        states.append(accepted)


def test_scores_match_the_rule(spark):
    rng = random.Random(4)
    lead, tail = ["user", "account", "badge", "in", "at"], ["today", "was", "and", "for"]
    ids = [lambda: f"EMP-{rng.randint(10000, 99999)}", lambda: f"{rng.randint(100, 999)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", lambda: f"u{rng.randint(0, 9)}@x.org", lambda: f"2024-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", lambda: f"build{rng.randint(100, 999)}"]
    texts = [" ".join(f"{rng.choice(lead)} {rng.choice(ids)()} {rng.choice(tail)}" for _ in range(3)) for _ in range(60)]
    texts += [f"badge u{k}@x.org today" for k in range(20)] + [f"badge {rng.randint(100, 999)}-45-{rng.randint(1000, 9999)} today" for _ in range(5)]
    spots = pii.written(pii.spotted(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "spots")
    seen = [(r.instance, r.fixed, r.patterns) for r in pii._occurrences(spots).collect()]
    ids_of = pii.discovered(spots).select(pii.F.explode("ids").alias("s"), "key").join(pii._occurrences(spots), "key").where("s.start = start and s.end = end").select("instance").distinct().collect()
    assert {r.instance for r in ids_of} == brute_ids(seen) != set()


def test_identifiers_of_digits_and_short_ones(spark):
    rows = [(k, f"alpha contact user{k}@example.org today beta") for k in range(40)]
    rows += [(40, "alpha contact 123-45-6789 today"), (41, "alpha contact EMP-48213 today"), (42, "alpha contact 987654321 today"), (43, "alpha contact 2024-05-06 today"), (44, "alpha contact 4041894974608795 today")]
    out = {r.doc_id: r.n_id for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[k] for k in range(40, 45)] == [1, 1, 1, 0, 0]  # a date, and a card number that fails its check


def test_plan_is_native(spark, odd):
    plan = pii.spotted(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_odd_rows(odd, odd_rows, empty):
    out = pii.extract(odd).collect()
    assert len(out) == len(odd_rows) and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in out) == 4
    assert pii.extract(empty).count() == 0 and pii.masked(odd).count() == len(odd_rows) and pii.masked(odd).columns == odd.columns
