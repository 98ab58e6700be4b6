import numpy as np
import pytest

from trialspan.llm import mixing


def test_targets_are_met(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = mixing.mixed(docs, labels).toPandas()
    assert len(out) == docs.count() and (out.rate >= 0).all()
    for name, share in mixing.TARGETS.items():
        assert (out.tokens * out.rate * out[f"p_{name}"]).sum() / out.tokens.sum() == pytest.approx(share, abs=0.005)


def test_rates_are_the_projected_recursion(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3, 0.3, 0.3], 200)
    tokens = rng.integers(0, 500, 200)
    rows = [(int(k), int(t), [float(v) for v in q]) for k, (t, q) in enumerate(zip(tokens, p, strict=True))]
    df = spark.createDataFrame(rows, "doc_id long, tokens long, posterior array<double>")
    aim = {"a": 0.7, "b": 0.25, "c": 0.05}
    rate, total = np.ones(200), tokens.sum()
    weight = np.linalg.inv((p * tokens[:, None]).T @ p / total + mixing.PULL * np.eye(3))
    out, moves, least = mixing.fitted(df, ["a", "b", "c"], aim)
    for step in range(len(moves) + 1):
        residual = (tokens * rate) @ p / total - np.array(list(aim.values()))
        if step < len(moves):
            assert np.allclose(moves[step], weight @ residual, atol=1e-9)
            rate = np.maximum(0, rate - mixing.STEP * (mixing.PULL * (rate - 1) + p @ weight @ residual))
    got = out.orderBy("doc_id").toPandas().rate.to_numpy()
    assert np.allclose(got, rate, atol=1e-6) and (got == 0).any() and np.abs(residual).max() == pytest.approx(least, abs=1e-9)


def test_steps_go_on_until_the_residual_is_least(spark, monkeypatch):
    """Many steps are taken where they help, and a target that no rates can meet ends them with its residual."""
    rng = np.random.default_rng(2)
    p = rng.dirichlet([2.0, 2.0, 2.0], 300)
    df = spark.createDataFrame([(k, 100, [float(v) for v in q]) for k, q in enumerate(p)], "doc_id long, tokens long, posterior array<double>")
    monkeypatch.setattr(mixing, "KEPT", 3)
    out, moves, least = mixing.fitted(df, ["a", "b", "c"], {"a": 0.5, "b": 0.3, "c": 0.2})
    assert least < 2e-3  # the pull towards rate 1 is in it
    out, moves, least = mixing.fitted(df, ["a", "b", "c"], {"a": 0.98, "b": 0.01, "c": 0.01})
    rate = out.orderBy("doc_id").toPandas().rate.to_numpy()
    assert len(moves) > 3 and least > 0.01 and np.abs(rate @ p / 300 - [0.98, 0.01, 0.01]).max() == pytest.approx(least, abs=1e-6)


def test_posteriors_match_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(30)]
    docs = [(k, " ".join(rng.choice(words[: 10 + 5 * (k % 3)], rng.integers(1, 60)))) for k in range(30)]
    labels = [(k, int(k % 2), int(k % 5 == 0)) for k in range(0, 30, 2)] + [(1, 1, 0), (3, 1, 0), (5, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = mixing.train(frame, mixing.domains(spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    name = lambda q, t: ("good" if q else "poor") + ("_toxic" if t else "")
    bucket = {w: int(mixing._buckets(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0]) for w in words}
    of = {k: name(q, t) for k, q, t in labels}
    counts, rows = {n: np.zeros(mixing.BUCKETS) for n in model[0]}, dict.fromkeys(model[0], 0)
    for k, t in docs:
        if k in of:
            rows[of[k]] += 1
            for w in t.split():
                counts[of[k]][bucket[w]] += 1
    every = sum(counts.values())
    overall = (every + 1 / mixing.BUCKETS) / (every.sum() + 1)
    for r in mixing.posteriors(frame, model).collect():
        w = docs[r.doc_id][1].split()
        logs = np.array([np.mean([np.log((counts[n][bucket[x]] + mixing.PRIOR * overall[bucket[x]]) / (counts[n].sum() + mixing.PRIOR)) for x in w]) * min(len(w), mixing.EVIDENCE) + np.log(rows[n] / sum(rows.values())) for n in model[0]])
        share = np.exp(logs - logs.max())
        assert r.tokens == len(w) and np.allclose(r.posterior, share / share.sum(), atol=1e-4)


def test_clashing_and_dotted_names(spark):
    docs = spark.createDataFrame([(1, "good words here", 7.0, 8.0, 9, 1.0), (2, "poor words there", 7.0, 8.0, 9, 1.0)], "doc_id long, text string, __x0 double, `a.b` double, tokens long, mix_rate double")
    out = mixing.weighted(docs, spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int"))
    assert out.columns == [*docs.columns, "mix_rate_"]
    assert all(tuple(r)[2:6] == (7.0, 8.0, 9, 1.0) for r in out.collect())


def test_odd_rows(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(7, 1, 0), (8, 0, 0), (6, 0, 1), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    out = mixing.mixed(odd, labels).collect()
    assert len(out) == len(odd_rows) and all(abs(r.p_good + r.p_poor + r.p_poor_toxic - 1) < 1e-6 and r.rate >= 0 for r in out)
    assert mixing.mixed(empty, labels).count() == 0
    none = mixing.mixed(odd, labels.limit(0)).collect()
    assert len(none) == len(odd_rows) and {r.rate for r in none} == {1.0}
    last = mixing.weighted(odd, labels)
    assert last.columns == [*odd.columns, "mix_rate"] and last.count() <= len(odd_rows)
