"""Mixing sources to target weights by soft membership.

A naive Bayes classifier over hashed words, fitted on a label table, gives every document a
posterior over domains, tempered so that long texts stay soft. Then nonnegative rates are
fitted to documents: the expected token total of each domain, sum of rate * tokens * posterior,
is to match its target share, by projected-gradient least squares with a pull towards rate 1.

A document's rate after any number of steps follows from its own row and the residuals of the
steps so far, so each step is one distributed sum of as many numbers as there are domains, and
no rates are sent between steps. Steps go on until the residual is met or as low as it gets.

Defined cases: a null or empty text has no tokens and uniform posteriors. A domain
without labelled rows has posterior 0 everywhere and its target is left out. With no labelled
rows at all every rate is 1. Rows without an id do not train. Repeated rows each get the same
rate. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from trialspan.llm import _arrays as A
from trialspan.llm._store import bounded_batches, col, dropped, fresh, written

BUCKETS = 1 << 15
#: Labelled rows that the classifier is fitted on at most: those with the least hashes of their ids.
LABELLED_ROWS = 20_000
#: Words that a text counts for in its posterior at most.
EVIDENCE = 100.0
PRIOR = 200.0
#: Length of a step of the projected gradient, the weight of the pull towards rate 1, and the residual that ends the steps.
STEP, PULL, DONE = 0.8, 0.002, 2e-4
#: Steps end as well where so many in a row have not lowered the least residual by this share: it is as low as it gets.
PATIENCE, GAIN = 8, 0.01
#: Steps after which the rates so far are written.
KEPT = 16
#: Share of tokens that each (quality, toxic) domain is to have.
TARGETS = {"good": 0.80, "poor": 0.13, "good_toxic": 0.06, "poor_toxic": 0.01}
_U = np.uint64


def domains(labels: DataFrame, most: int = LABELLED_ROWS) -> DataFrame:
    """(doc_id, domain) of at most `most` labelled documents, by quality and toxicity."""
    name = F.concat(F.when(F.col("quality") == 1, "good").otherwise("poor"), F.when(F.col("toxic") == 1, "_toxic").otherwise(""))
    rows = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(name).alias("domain"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _buckets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = A.words(data, off)
    return (A.spans(A.prefix(data), starts, ends) >> _U(49)).astype(np.int64), first


def train(docs: DataFrame, labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """(domains, log of likelihoods by bucket and domain with a last row of priors); labelled has at most LABELLED_ROWS rows, so it may be broadcast."""
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text").join(F.broadcast(labelled.select("doc_id", "domain")), "doc_id").select("domain", "text")

    @A.lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column("domain").to_pylist()
            for i, j, off, data in A.slices(batch.column("text")):
                b, first = _buckets(data, off)
                for k in range(i, j):
                    here = b[first[k - i] : first[k - i + 1]]
                    held.setdefault(names[k], np.zeros(BUCKETS, np.int64))
                    held[names[k]] += np.bincount(here, minlength=BUCKETS)
        for name, n in held.items():
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(seen), pa.string()), pa.array(seen), pa.array(n[seen])], names=["domain", "bucket", "n"])

    found = rows.mapInArrow(count, "domain string, bucket long, n long").groupBy("domain", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(pc.unique(found.column("domain")).to_pylist())
    counts = np.zeros((BUCKETS, len(names)))
    for c, name in enumerate(names):
        own = found.filter(pc.equal(found.column("domain"), name))
        counts[own.column("bucket").to_numpy(), c] = own.column("n").to_numpy()
    if not names:
        return [], counts
    rows = {r["domain"]: r["count"] for r in labelled.groupBy("domain").count().collect()}
    prior = np.log(np.array([[rows[n] for n in names]]) / sum(rows[n] for n in names))
    overall = (counts.sum(1, keepdims=True) + 1.0 / BUCKETS) / (counts.sum() + 1.0)
    return names, np.concatenate((np.log((counts + PRIOR * overall) / (counts.sum(0) + PRIOR)), prior))


def posteriors(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str] = ("doc_id",), moves: list[list[float]] | None = None, text: str = "text") -> DataFrame:
    """The columns to keep, then tokens and posterior, an array in the order of the model's domains; or, given moves, the rate after them."""
    keep, at = list(keep), len(keep)
    names, likelihood = model
    shared = docs.sparkSession.sparkContext.broadcast(likelihood.astype(np.float32))
    rows = docs.select(*(col(c) for c in keep), col(text).alias("text")).toDF(*(f"c{k}" for k in range(at + 1)))  # Arrow functions take no dotted names
    schema = StructType(rows.schema.fields[:at])
    schema = schema.add("tokens", "long").add("posterior", ArrayType(DoubleType())) if moves is None else schema.add("rate", "double")

    @A.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(names)
        for batch in batches:
            tokens, share = np.zeros(len(batch), np.int64), np.full((len(batch), k), 1.0 / max(k, 1))
            for i, j, off, data in A.slices(batch.column(at)):
                b, first = _buckets(data, off)
                n = np.diff(first)
                tokens[i:j] = n
                full = np.flatnonzero(n > 0)
                if len(full) and k:
                    mean = np.add.reduceat(shared.value[b], first[:-1][full], axis=0, dtype=np.float64) / n[full][:, None]
                    score = mean * np.minimum(n[full], EVIDENCE)[:, None] + shared.value[BUCKETS]
                    weight = np.exp(score - score.max(1, keepdims=True))
                    share[i + full] = weight / weight.sum(1, keepdims=True)
            if moves is None:
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(batch) * k + 1, k) if k else np.zeros(len(batch) + 1), pa.int32()), pa.array(share.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(tokens), lists], names=schema.names)
            else:
                rate = np.ones(len(batch))
                for move in moves:
                    rate = np.maximum(0.0, rate - STEP * (PULL * (rate - 1.0) + share @ np.array(move)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(rate)], names=schema.names)

    return rows.mapInArrow(run, schema).toDF(*keep, *schema.names[at:])


def _moved(rate: str, moves: list[list[float]]) -> F.Column:
    """rate after moves: max(0, rate - STEP * (PULL * (rate - 1) + p . move)) each time."""
    for move in moves:
        drop = " + ".join(f"posterior[{k}] * {STEP * v!r}D" for k, v in enumerate(move))
        rate = f"greatest(0.0D, {rate} * {1.0 - STEP * PULL!r}D + ({STEP * PULL!r}D - ({drop})))"
    return F.expr(rate)


def fitted(members: DataFrame, names: list[str], targets: dict[str, float] | None = None) -> tuple[DataFrame, list[list[float]], float]:
    """(members with rate, moves of all steps, largest difference of an expected share and its target). members has tokens and posterior; totals are shares of all tokens."""
    targets = TARGETS if targets is None else targets
    aim = np.array([targets.get(n, 0.0) for n in names])
    total = members.agg(F.sum("tokens")).head()[0]
    x = members.withColumn("rate", F.lit(1.0))
    if not names or not total or not aim.sum():
        return x, [], 0.0
    aim = aim / aim.sum()
    k = len(names)
    p = [F.col("posterior")[i] for i in range(k)]
    upper = iter(x.agg(*(F.sum(F.col("tokens") * p[a] * p[b]) for a in range(k) for b in range(a, k))).head())
    square = np.zeros((k, k))
    for a in range(k):
        for b in range(a, k):
            square[a, b] = square[b, a] = next(upper)
    weight = np.linalg.inv(square / total + PULL * np.eye(k))
    moves: list[list[float]] = []
    least, since, best, late, held = np.inf, 0, 0, [], None
    while True:
        residual = np.array(x.agg(*(F.sum(F.col("tokens") * _moved("rate", late) * q) for q in p)).head()) / total - aim
        worst = float(np.abs(residual).max())
        since = 0 if worst < least * (1.0 - GAIN) else since + 1
        if worst < least:
            least, best = worst, len(moves)
        if worst < DONE or since >= PATIENCE:
            break
        moves.append([float(v) for v in weight @ residual])
        late.append(moves[-1])
        if len(late) == KEPT:
            x = written(x.withColumn("rate", _moved("rate", late)), "rates")
            if held is not None:
                dropped(held)
            late, held = [], x
    moves = moves[:best]  # the steps up to the least residual
    return members.withColumn("rate", F.lit(1.0)).withColumn("rate", _moved("rate", moves)) if best <= KEPT else _replayed(members, moves), moves, least


def _replayed(members: DataFrame, moves: list[list[float]]) -> DataFrame:
    """members with the rate after moves, in stretches that are written, so that no expression grows with the steps."""
    x = members.withColumn("rate", F.lit(1.0))
    for k in range(0, len(moves), KEPT):
        x = written(x.withColumn("rate", _moved("rate", moves[k : k + KEPT])), "rates")
    return x


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, tokens, a posterior p_<domain> for each domain, rate, residual) for each row; residual, the same everywhere, is the largest difference of a domain's expected share and its target."""
    model = train(docs, domains(labels))
    members = written(posteriors(docs, model), "posteriors")
    out, _, residual = fitted(members, model[0], targets)
    return out.select("doc_id", "tokens", *(F.col("posterior")[i].alias(f"p_{n}") for i, n in enumerate(model[0])), "rate", F.lit(residual).alias("residual"))


def weighted(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """docs, all columns, with mix_rate; documents whose rate is 0 go. Posteriors are taken again in the pass that adds the rates, so no text is shuffled."""
    model = train(docs, domains(labels))
    members = written(posteriors(docs, model), "posteriors")
    _, moves, _ = fitted(members, model[0], targets)
    dropped(members)
    columns = docs.columns
    name = fresh("mix_rate", columns)
    out = posteriors(docs, model, columns, moves).toDF(*columns, name)
    return out.where(col(name) > 0)
