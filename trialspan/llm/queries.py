"""The queries of this subpackage over the tables of one folder, with production parameters, and their SQL where there is any."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspan.llm import alignment, decontaminate, divergence, language, licenses, lines, mixing, neardup, paragraphs, pii, quality, substrings, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP2_SQL = r"""
with recursive word as materialized (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as materialized (select doc_id, case when w is null or len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from word),
class as materialized (select s, len(s) as n, min(doc_id) as rep from (select doc_id, list_sort(s) as s from sets) group by s),
item as materialized (select rep, n, unnest(s) as g from class where n > 0),
link as materialized (select a.rep as a, b.rep as b from item a join item b on a.g = b.g and a.rep <> b.rep group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach as (select rep as a, rep as b from class union select r.a, l.b from reach r join link l on r.b = l.a),
part as (select a as rep, min(b) as part from reach group by a)
select d.doc_id, cast(c.n as bigint) as n_shingles, case when c.n = 0 then d.doc_id else p.part end as component_id, (c.n = 0 or p.part = d.doc_id) as kept
from (select doc_id, list_sort(s) as s from sets) d join class c on d.s = c.s join part p on p.rep = c.rep
"""


#: Bytes as pairs of hexadecimal digits.
OP8_SQL = """
with doc as materialized (select doc_id, hex(encode(coalesce(text, ''))) as x, cast(octet_length(encode(coalesce(text, ''))) as bigint) as n from documents),
string as (select doc_id, i, substring(x, 2 * i - 1, 100) as s from (select doc_id, x, unnest(range(1, n - 48)) as i from doc)),
gone as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by s) as first_doc from string) where first_doc < doc_id),
island as (select doc_id, i, sum(cast(b is null or i > b + 50 as int)) over (partition by doc_id order by i rows unbounded preceding) as k from (select *, lag(i) over (partition by doc_id order by i) as b from gone)),
span as (select doc_id, min(i) as lo, max(i) + 49 as hi from island group by doc_id, k),
piece as (select s.doc_id, lo, hi, substring(x, 2 * coalesce(lag(hi) over w, 0) + 1, 2 * (lo - 1 - coalesce(lag(hi) over w, 0))) as kept from span s join doc using (doc_id) window w as (partition by s.doc_id order by lo)),
cut as (select doc_id, sum(hi - lo + 1) as n_removed, count(*) as n_spans, max(hi) as hi, string_agg(kept, '' order by lo) as kept from piece group by doc_id)
select doc_id, n as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept || substring(x, 2 * hi + 1), x))) as kept_sha256 from doc left join cut using (doc_id)
"""


OP12_SQL = r"""
with line as materialized (select doc_id, i, x[i] as l, translate(trim(x[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, x, unnest(range(1, len(x) + 1)) as i from (select doc_id, string_split(coalesce(text, ''), chr(10)) as x from documents))),
often as (select k from line where length(k) >= 1 group by k having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(o.k) as n_dropped, sha256(coalesce(string_agg(l, chr(10) order by i) filter (o.k is null), '')) as kept_sha256 from line left join often o using (k) group by doc_id
"""


OP13_SQL = r"""
with doc as materialized (select coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
posting as materialized (select lang, source, term, count(*) as n from (select lang, source, r, unnest(w) as term from (select *, row_number() over () as r from doc)) group by lang, source, r, term),
kept as materialized (select lang, term, sum(n) as n from posting group by lang, term having count(*) >= 10),
of_lang as (select lang, count(*) as v, sum(n) as total from kept group by lang),
grp as materialized (select distinct lang, source from doc),
cell as materialized (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, k.n as all_n from grp g join kept k on g.lang = k.lang
  left join (select lang, source, term, sum(n) as n from posting group by lang, source, term) c on c.lang = g.lang and c.source = g.source and c.term = k.term),
share as materialized (select c.lang, c.source, c.term, c.n, 1 + (1000000000::hugeint * (c.n + 2)) // (sum(c.n) over (partition by c.lang, c.source) + 2 * v) as p, 1 + (1000000000::hugeint * (all_n + 2)) // (total + 2 * v) as q
  from cell c join of_lang l on c.lang = l.lang),
pair as (select x.lang, x.source, y.source as item, coalesce(s.value, 0) as value from grp x join grp y on x.lang = y.lang and x.source <> y.source
  left join (select a.lang, a.source as a, b.source as b, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value from share a join share b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source) s
  on s.lang = x.lang and s.a = x.source and s.b = y.source),
term as (select lang, source, term as item, ((p - q) * (p - q)) // (p + q) as value from share where n > 0 and p > q)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from (
  select *, 'pair' as part, row_number() over (partition by lang, source order by value desc, encode(item)) as rank from pair
  union all by name select *, 'term' as part, row_number() over (partition by lang, source order by value desc, encode(item)) as rank from term) where part = 'pair' or rank <= 10
"""


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.where(~language.held_out()))
    return language.identify(docs.withColumn("held_out", language.held_out()), model, ["doc_id", "held_out"])


def op2_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    fit, unseen = quality.halves(quality.trusted_ids(_table(spark, sf_dir, "labels")))
    ratios = quality.train(docs, fit)
    return quality.rate(docs, ratios, quality.calibrated(docs, unseen, ratios))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def op6_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.extract(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(_table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op10_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated(_table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alignment.aligned(_table(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.deduplicated(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def _op9_sql() -> str:
    """Phrases as positions in the list of words, templates as regular expressions over the words in a row."""
    places = [" and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split())) for phrase, _ in licenses.PHRASES]
    hits = [f"list_filter(range(1, len(w) + 1), lambda i: {place})" for place in places]
    rules: list[tuple[str, str]] = []
    for template, label in licenses.TEMPLATES:
        parts = re.findall(r"\[[^\]]*\]|\{\d+\}|\S+", template)
        rules.append(("".join(f"({x[1:-1]} )?" if x[0] == "[" else f"([^ ]+ ){{0,{x[1:-1]}}}" if x[0] == "{" else f"{x} " for x in parts), label))
    base = ", ".join(f"case when len(h{k}) > 0 then '{label}' end" for k, (_, label) in enumerate(licenses.PHRASES))
    more = ", ".join(f"case when regexp_matches(t, ' {rule}') then '{label}' end" for rule, label in rules)
    joined = lambda x: f"coalesce(array_to_string(list_sort(list_distinct(list_filter([{x}], lambda x: x is not null))), ','), '')"
    return rf"""
with word as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
hit as (select doc_id, w, ' ' || array_to_string(w, ' ') || ' ' as t, {", ".join(f"{h} as h{k}" for k, h in enumerate(hits))} from word),
every as (select *, flatten([{", ".join(f"h{k}" for k in range(len(hits)))}]) as h from hit)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(h) as bigint) as n_base, cast(list_min(h) - 1 as bigint) as first_word, cast(list_max(h) - 1 as bigint) as last_word,
{joined(base)} as base_labels, {joined(base + ", " + more)} as labels, cast(case when {joined(more)} <> '' then 1.0 when len(h) > 0 then 0.5 else 0.0 end as double) as score from every
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash_neardup": OP2_SQL, "op8_suffix_dedup": OP8_SQL, "op9_license_scan": _op9_sql(), "op12_line_dedup": OP12_SQL, "op13_source_divergence": OP13_SQL}
