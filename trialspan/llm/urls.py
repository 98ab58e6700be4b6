"""URL filters: host and path rules first, a character language-model ratio for the rest.

The longest rule that fits decides. Half of the URLs that a rule decides, by a hash of
their ids, train two smoothed variable-order Markov models, of accepted and of rejected URLs.
Another URL's score is the difference of their log-likelihoods in bits a byte; it is blocked
below a threshold calibrated on the other half, so that at most a stated share of its accepted
URLs would be blocked.

Defined cases: a null URL, or one without `://`, has empty host and path, fits no rule and has
score 0. If the URLs to train on have none that is accepted, or none rejected, there is no
model and the rest is allowed. Repeated rows count as often as they occur. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspan.llm import _context
from trialspan.llm._arrays import LOWER, lean, slices
from trialspan.llm._store import bounded_batches

#: (host, path, verdict)
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: Share of accepted URLs that the calibrated threshold may block.
FALSE_BLOCKS = 0.001
#: Scores are calibrated on a grid of so many steps a bit.
GRID = 100
#: Bytes as the models see them: A-Z in lower case, digits as 0.
FOLD = LOWER.copy()
FOLD[0x30:0x3A] = 0x30


def parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """(host, path)"""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _first(rules: list[tuple[str, str, str]], value: int | None) -> F.Column:
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("host") == rule[0]) | F.col("host").endswith("." + rule[0])) & F.col("path").startswith(rule[1])
        out = F.when(fits, rule[0] + rule[1] if value is None else rule[value]).otherwise(out)
    return out


def ruled(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, url, host, path, rule, decided)"""
    host, path = parts(F.col("url"))
    return pages.select("page_id", "url").select("page_id", "url", host.alias("host"), path.alias("path")).select("*", _first(rules, None).alias("rule"), _first(rules, 2).alias("decided"))


def _scored(rows: DataFrame, models: list[_context.Models], keep: list[str]) -> DataFrame:
    """keep and score: bits a byte that the model of rejected URLs needs beyond that of accepted ones, whichever blocks hold them."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(len(batch))
            for i, j, off, data in slices(batch.column("url")):
                keys = _context.packed(data, off, FOLD)
                bits = {name: column for block in shared.value for name, column in zip(block.names, block.summed(keys, off).T, strict=True)}
                score[i:j] = (bits["block"] - bits["allow"]) / np.maximum(np.diff(off), 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(score)], names=[*keep, "score"])

    return rows.select(*dict.fromkeys([*keep, "url"])).mapInArrow(run, rows.select(*keep).schema.add("score", "double"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, false_blocks: float = FALSE_BLOCKS) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row of pages (page_id, url)."""
    bounded_batches(pages.sparkSession)
    rows = ruled(pages, rules)
    labelled = rows.where(F.col("decided").isNotNull()).withColumn("odd", F.coalesce(F.pmod(F.xxhash64("page_id"), F.lit(2)) == 1, F.lit(False)))
    fit = labelled.where(~F.col("odd")).select(F.col("decided").alias("label"), F.col("url").alias("text"))
    models = _context.fit(fit, FOLD)
    keep = ["page_id", "host", "path", "rule", "decided"]
    if [n for m in models for n in m.names] != ["allow", "block"]:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("decided", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    good = _scored(labelled.where("odd and decided = 'allow'"), models, ["decided"]).groupBy(F.floor(F.col("score") * GRID).alias("step")).count().toPandas()
    good = good.sort_values("step")  # bits a character are bounded, so the grid is
    at = int(np.searchsorted(good["count"].cumsum(), false_blocks * good["count"].sum(), "right"))
    threshold = min(good["step"].iloc[min(at, len(good) - 1)] / GRID, 0.0) if len(good) else 0.0
    verdict = F.coalesce("decided", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return _scored(rows, models, keep).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
