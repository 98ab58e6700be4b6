"""Quality rules by importance of hashed n-grams.

Two multinomials over hashed word uni- and bigrams are counted: one of a trusted target (rows
that a label table vouches for) and one of the whole raw corpus. A text's score is the mean
over its n-grams of log(target / corpus), so length does not matter. Every document is decided
by the same threshold, near the least scores of trusted rows that the target was not
fitted on; nothing is drawn at random. Base counts of words, symbols, repeated
lines and repeated words come with it, and a text that fails them is not kept.

Defined cases: a null or empty text has zero counts and fails the base rules. With no trusted
row, or an empty corpus, scores are 0. An n-gram bucket unseen in both counts as equally likely. Repeated
rows count as often as they occur. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspan.llm import _arrays as A
from trialspan.llm._store import bounded_batches, dropped, narrow, written

BUCKETS = 1 << 16
#: Pseudo-count of every bucket, as a share of the corpus's distribution.
PRIOR = 1000.0
#: The threshold: this share of unseen trusted texts may score less; without such texts, a fixed one.
LOWEST, THRESHOLD = 0.005, -0.75
MIN_WORDS = 50
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_U = np.uint64


def buckets(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of the uni- and bigrams of all texts, in the order of texts; first n-gram of each text and the total)."""
    n = len(h)
    if n == 0:
        return np.empty(0, np.int64), np.zeros(len(first), np.int64)
    out = np.empty((n, 2), np.int64)
    out[:, 0] = h >> _U(48)
    out[:-1, 1] = A.grams(h, 2) >> _U(48)
    use = np.ones((n, 2), bool)
    last = first[1:][np.diff(first) > 0] - 1
    use[last, 1] = False
    counts = 2 * np.diff(first) - (np.diff(first) > 0)
    return out[use], np.concatenate(([0], np.cumsum(counts)))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of all documents labelled good and not toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()


def halves(trusted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trusted ids to fit the target on, and others to set the threshold on."""
    odd = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    return trusted.where(~odd), trusted.where(odd)


def calibrated(docs: DataFrame, unseen: DataFrame, ratios: np.ndarray) -> float:
    """The threshold from the scores of trusted rows that did not fit the ratios; scores are counted, and only the lowest are sorted."""
    rows = docs.join(narrow(unseen.select("doc_id")), "doc_id", "left_semi")
    scores = written(rate(rows, ratios).where("not base_failed").select("score"), "scores")
    at = int(scores.count() * LOWEST)
    low = scores.orderBy("score").limit(at + 1).agg(F.max("score")).head()[0]
    dropped(scores)
    return min(low, 0.0) if low is not None else THRESHOLD


def train(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """log(target / corpus) of each bucket; `trusted` is broadcast while it is narrow."""
    bounded_batches(docs.sparkSession)
    vouched = narrow(trusted.select(F.col("doc_id").alias("__id"), F.lit(True).alias("__t")))
    rows = docs.join(vouched, F.col("doc_id") == F.col("__id"), "left").select("text", F.coalesce("__t", F.lit(False)).alias("t"))

    @A.lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            mark = batch.column("t").to_numpy(zero_copy_only=False).astype(bool)
            for i, j, off, data in A.slices(batch.column("text")):
                starts, ends, first = A.words(data, off)
                b, at = buckets(A.spans(A.prefix(data), starts, ends), first)
                total += np.bincount(b, minlength=BUCKETS)
                if mark[i:j].any():
                    good += np.bincount(b[np.repeat(mark[i:j], np.diff(at))], minlength=BUCKETS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen]), pa.array(good[seen])], names=["bucket", "n", "good"])

    found = rows.mapInArrow(count, "bucket long, n long, good long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).toArrow()
    n, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    n[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    good[found.column("bucket").to_numpy()] = found.column("good").to_numpy()
    if not good.sum():
        return np.zeros(BUCKETS)
    raw = (n + 1.0 / BUCKETS) / (n.sum() + 1.0)
    return np.log((good + PRIOR * raw) / (good.sum() + PRIOR) / raw)


def repeated(h: np.ndarray, first: np.ndarray, window: int = 3) -> np.ndarray:
    """Words of each text that lie in a window of `window` words found twice or more in the text."""
    rows, n = len(first) - 1, len(h)
    if n < window:
        return np.zeros(rows, np.int64)
    of = A.of_rows(first)
    g = A.grams(h, window)
    at = np.flatnonzero(of[: n - window + 1] == of[window - 1 :])
    key = A.mix(g[at] ^ A.mix(of[at].astype(_U) + _U(1)))
    order = np.argsort(key)
    same = np.zeros(len(at), bool)
    equal = key[order][1:] == key[order][:-1]
    same[order[1:][equal]] = True
    same[order[:-1][equal]] = True
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at[same], 1)
    np.add.at(change, at[same] + window, -1)
    return np.bincount(of[np.cumsum(change)[:n] > 0], minlength=rows)


def duplicate_lines(data: np.ndarray, off: np.ndarray, word_starts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of the same text."""
    rows, n = len(off) - 1, len(data)
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate((off[:-1][np.diff(off) > 0], breaks + 1)))
    starts = starts[starts < n]
    if not len(starts):
        return np.zeros(rows, np.int64)
    ends = np.append(starts[1:], n)
    of = np.searchsorted(off, starts, "right") - 1
    ends = np.minimum(ends, off[of + 1])
    ends = ends - (data[ends - 1] == 10)
    worded = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    starts, ends, of = starts[worded], ends[worded], of[worded]
    key = A.mix(A.spans(sums, starts, ends) ^ A.mix(of.astype(_U) + _U(1)))
    _, where = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[where] = False
    return np.bincount(of[again], minlength=rows)


def rate(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]

    @A.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = len(batch)
            n_words, chars, symbols, lines, again = (np.zeros(rows, np.int64) for _ in range(5))
            score = np.zeros(rows)
            for i, j, off, data in A.slices(batch.column("text")):
                starts, ends, first = A.words(data, off)
                sums = A.prefix(data)
                h = A.spans(sums, starts, ends)
                n_words[i:j] = np.diff(first)
                marks = np.concatenate(([0], np.cumsum(A.IS_WORD[data] & ((data & 0xC0) != 0x80))))
                chars[i:j] = marks[off[1:]] - marks[off[:-1]]
                marks = np.concatenate(([0], np.cumsum(SYMBOLS[data])))
                symbols[i:j] = marks[off[1:]] - marks[off[:-1]]
                lines[i:j] = duplicate_lines(data, off, starts, sums)
                again[i:j] = repeated(h, first)
                b, at = buckets(h, first)
                full = np.flatnonzero(np.diff(at) > 0)
                if len(full):
                    score[i + full] = np.add.reduceat(shared.value[b], at[:-1][full]) / np.diff(at)[full]
            failed = (n_words < MIN_WORDS) | (100 * again > 50 * n_words)
            values = [n_words, chars, symbols, lines, again, failed, score, ~failed & (score >= threshold)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, values)], names=names)

    schema = docs.select("doc_id").schema
    for name in names[1:6]:
        schema = schema.add(name, "long")
    return docs.select("doc_id", "text").mapInArrow(run, schema.add("base_failed", "boolean").add("score", "double").add("kept", "boolean"))
