"""Personal data by patterns and by bootstrapped contextual extraction, in DataFrame functions only.

Base finds are leftmost non-overlapping matches of four kinds, checked by value. They seed a
graph of instances (strings of letters and digits) and lexical patterns (the word before, the word
after, and a label such as `key =` before). In each round a pattern's confidence is the share of
positive evidence among its distinct instances, where one not yet judged counts in part, and an
instance's score is the noisy-or of its confident patterns; seeds stay at 1 and dates at 0. Rounds
go on until the accepted instances are those of an earlier round. Accepted instances are added as
spans of kind `id`, so identifiers of no known form are found where known ones occur. What has
the form of a base kind and fails its check is never an instance.

The regular expressions match as the plain ones in KINDS do. They differ only by possessive
repetition and by a look-behind that starts runs at their beginning, so very long texts cost
time in proportion to their length.

Defined cases: a null or empty text has no spans, and the digest of the empty string. Spans
belong to rows, not to ids, so rows without an id and rows that repeat one are treated as any
other. Spans of different kinds may overlap. Other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspan.llm._store import NARROW, col, dropped, written

#: (kind, quick test, expression)
KINDS = [
    ("email", "contains(text, '@')", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"text rlike r'[0-9]\.[0-9]'", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"text rlike r'[0-9](?:[ -]?[0-9]){15}'", r"[0-9](?:[\x20-]?+[0-9])++"),
    ("phone", r"contains(text, '+')", r"\+[0-9][\x20().0-9-]+[0-9]"),
]
#: A blank-separated token with a digit.
TOKEN = r"(?<!\S)(?=\S{6})[^\s0-9]*+[0-9]\S*+"
#: Characters of context looked at on each side; the least length of an identifier, as in TOKEN, and its least digits.
CONTEXT, LEAST, DIGITS = 64, 6, 3
#: A day of the calendar, with the year first or last.
DATE = r"^(?:(?:1[5-9]|2[01])[0-9]{2}[-/](?:0?[1-9]|1[0-2])[-/](?:0?[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])[-/](?:0?[1-9]|[12][0-9]|3[01])[-/](?:1[5-9]|2[01])?[0-9]{2})(?![0-9])"
#: Spans whose places are summed at once; so many times their number is what places cost.
STRIDE = 256
#: Parts that a pattern's instances are dealt to where they are joined.
SALT = 16
#: Patterns and instances that count: confidence, positive instances and score at least.
PATTERN_CONFIDENCE, PATTERN_SUPPORT, INSTANCE_SCORE = 0.5, 2, 0.5
#: What an instance that is not yet judged counts against a pattern, and what any pattern has against it.
UNJUDGED, DOUBT = 0.3, 0.5
_SPAN = "array<struct<start:int,end:int,found:string,left:string,right:string>>"


def _quoted(expression: str) -> str:
    return "r'" + expression + "'"


def _matches(expression: str, quick: str) -> Column:
    """Spans (start, end, found, left, right) in code points of all matches in `text`, with what lies between as context.

    A split leaves what is between the matches, so lengths give places. They are summed within
    strides and then over strides, as a fold that appends costs the square of its length.
    Lambdas bind what is used more than once, so each regular expression runs twice a text.
    """
    e = _quoted(expression)
    row = f"named_struct('gap', char_length(z.p[i - 1]), 'size', char_length(z.m[i - 1]), 'found', z.m[i - 1], 'left', substring(z.p[i - 1], -{CONTEXT}, {CONTEXT}), 'right', left(z.p[i], {CONTEXT}))"
    rows = f"case when size(z.m) = 0 then cast(array() as array<struct<gap:int,size:int,found:string,left:string,right:string>>) else transform(sequence(1, size(z.m)), i -> {row}) end"
    within = f"""aggregate(part, named_struct('at', 0, 'out', cast(array() as {_SPAN})), (a, x) -> named_struct('at', a.at + x.gap + x.size,
      'out', array_append(a.out, named_struct('start', a.at + x.gap, 'end', a.at + x.gap + x.size, 'found', x.found, 'left', x.left, 'right', x.right))))"""
    strides = f"case when size(rows) = 0 then cast(array() as array<struct<at:int,out:{_SPAN}>>) else transform(sequence(0, (size(rows) - 1) div {STRIDE}), c -> transform(array(slice(rows, int(c) * {STRIDE} + 1, {STRIDE})), part -> {within})[0]) end"
    offsets = "aggregate(strides, named_struct('at', 0, 'out', cast(array() as array<int>)), (a, x) -> named_struct('at', a.at + x.at, 'out', array_append(a.out, a.at)), a -> a.out)"
    moved = "flatten(zip_with(strides, offsets, (x, o) -> transform(x.out, s -> named_struct('start', s.start + o, 'end', s.end + o, 'found', s.found, 'left', s.left, 'right', s.right))))"
    bound = f"transform(array({offsets}), offsets -> {moved})[0]"
    bound = f"transform(array({strides}), strides -> {bound})[0]"
    bound = f"transform(array({rows}), rows -> {bound})[0]"
    bound = f"transform(array(named_struct('p', split(text, {e}, -1), 'm', regexp_extract_all(text, {e}, 0))), z -> {bound})[0]"
    return F.expr(f"case when {quick} then {bound} else cast(array() as {_SPAN}) end")


def _valid(kind: str) -> Column:
    """The spans in the column of that kind that hold by value."""
    digits = "regexp_replace(s.found, '[^0-9]', '')"
    test = {
        "email": "true",
        "ip": r"forall(split(s.found, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(ltrim('0', p) as int), 0) <= 255)",
        "card": f"length({digits}) between 16 and 19 and aggregate(sequence(1, least(length({digits}), 19)), 0, (a, i) -> a + case when i % 2 = 1 then int(substring(reverse({digits}), i, 1)) else int(substring(reverse({digits}), i, 1)) * 2 - 9 * int(int(substring(reverse({digits}), i, 1)) > 4) end) % 10 = 0",
        "phone": f"length({digits}) between 8 and 15",
    }[kind]
    return F.expr(f"filter({kind}, s -> {test})")


def _misformed(kind: str) -> str:
    """Matches in the column of that kind that have its form and fail its check, as an expression; `good` holds the ones that pass."""
    form = {"card": "length(regexp_replace(s.found, '[^0-9]', '')) between 16 and 19", "email": "false"}.get(kind, "true")
    return f"filter({kind}, s -> {form} and not array_contains(good_{kind}.start, s.start))"


def spotted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """(key, doc_id, email, ip, card, phone, seeds, tokens, and row if whole): base spans of each row, and spans with context of seeds and of other tokens with digits.

    key tells rows apart once the result is written.
    """
    row = [F.struct(*(col(c) for c in docs.columns)).alias("row")] if whole else []
    rows = docs.select(F.monotonically_increasing_id().alias("key"), col(doc_id).alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text"), *row)
    keep = ["key", "doc_id", *(["row"] if whole else [])]
    kinds = [k for k, _, _ in KINDS]
    found = rows.select(*keep, *(_matches(e, q).alias(k) for k, q, e in KINDS), _matches(TOKEN, "text rlike '[0-9]'").alias("tokens"))
    checked = found.select("*", *(_valid(k).alias(f"good_{k}") for k in kinds))
    taken = "concat(" + ", ".join([*(f"good_{k}" for k in kinds), *(_misformed(k) for k in kinds)]) + ")"
    others = f"transform(array({taken}), taken -> filter(tokens, t -> char_length(t.found) >= {LEAST} and not exists(taken, s -> s.start < t.end and t.start < s.end)))[0]"
    place = "transform(good_{0}, s -> named_struct('start', s.start, 'end', s.end))"
    return checked.select(*keep, *(F.expr(place.format(k)).alias(k) for k in kinds), F.expr("concat(" + ", ".join(f"good_{k}" for k in kinds) + ")").alias("seeds"), F.expr(others).alias("tokens"))


def _occurrences(spots: DataFrame) -> DataFrame:
    """(key, start, end, instance, fixed, patterns): fixed is 1 for seeds, 0 for dates, else null."""
    seeds = spots.select("key", F.explode("seeds").alias("s")).select("key", "s.*", F.col("s.found").alias("instance"), F.lit("").alias("lead"), F.lit(1.0).alias("fixed"))
    run = rf"([A-Za-z0-9+/_-]{{{LEAST},}})[^A-Za-z0-9]*$"
    tokens = spots.select("key", F.explode("tokens").alias("s")).select("key", "s.*").withColumn("instance", F.regexp_extract("found", run, 1))
    tokens = tokens.where(F.length(F.regexp_replace("instance", "[^0-9]", "")) >= DIGITS)
    lead = F.expr("substring_index(found, instance, 1)")
    tokens = tokens.select("key", "start", "end", "found", "left", "right", "instance", lead.alias("lead"), F.when(F.col("instance").rlike(DATE), 0.0).alias("fixed"))
    both = seeds.unionByName(tokens)
    word = r"[\p{L}]+"
    patterns = F.array(
        F.concat(F.lit("L "), F.lower(F.regexp_extract("left", rf"({word})[^\p{{L}}\s]*\s+$", 1))),
        F.concat(F.lit("R "), F.lower(F.regexp_extract("right", rf"^[^\p{{L}}\s]*\s+({word})", 1))),
        F.concat(F.lit("K "), F.lower(F.regexp_extract(F.concat("left", "lead"), "([A-Za-z_]{3,20})\\s*[=:]\\s*[\"']?$", 1))),
    )
    start = F.col("start") + F.char_length("lead")
    return both.select("key", start.cast("int").alias("start"), (start + F.char_length("instance")).cast("int").alias("end"), "instance", "fixed", F.filter(patterns, lambda p: F.length(p) > 2).alias("patterns"))


def discovered(spots: DataFrame) -> DataFrame:
    """(key, ids): spans of instances that confident patterns support, from a written table of spots."""
    seen = written(_occurrences(spots), "occurrences")
    edges = written(seen.select("instance", "fixed", F.explode("patterns").alias("pattern")).groupBy("instance", "pattern").agg(F.max("fixed").alias("fixed")), "edges")
    counts, scores, earlier = F.col("score") >= INSTANCE_SCORE, None, set()
    accepted = F.count_if(counts), F.sum(F.when(counts, F.xxhash64("instance").cast("decimal(38,0)")))
    while True:
        now = edges.select("*", F.coalesce("fixed", F.lit(0.0)).alias("score")) if scores is None else edges.join(scores, "instance", "left").select(*edges.columns, F.coalesce("fixed", "score", F.lit(0.0)).alias("score"))
        positive = F.when(counts, F.col("score")).otherwise(0.0)
        against = F.when(counts, 0.0).when(F.col("fixed") == 0.0, 1.0).otherwise(UNJUDGED)
        rated = now.groupBy("pattern").agg((F.sum(positive) / (F.sum(positive) + F.sum(against) + F.lit(DOUBT))).alias("confidence"), F.count_if(counts).alias("support"))
        rated = rated.where((F.col("confidence") >= PATTERN_CONFIDENCE) & (F.col("support") >= PATTERN_SUPPORT))
        rated = rated.select("pattern", F.ln(F.greatest(1.0 - F.col("confidence"), F.lit(1e-9))).alias("doubt"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))).alias("salt"))
        open_ = now.where(F.col("fixed").isNull()).select("instance", "pattern", F.pmod(F.xxhash64("instance"), F.lit(SALT)).alias("salt"))
        after = written(open_.join(rated, ["pattern", "salt"]).groupBy("instance").agg((1.0 - F.exp(F.sum("doubt"))).alias("score")), "scores", *accepted)
        if scores is not None:
            dropped(scores)
        scores, state = after, tuple(after.stats)
        if state in earlier or not state[0]:
            break
        earlier.add(state)
    found = seen.where(F.col("fixed").isNull()).join(scores.where(counts).select("instance"), "instance", "left_semi")
    out = written(found.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("ids")), "ids", F.sum(F.size("ids") + 1))
    dropped(seen, edges, scores)
    return out


def _with_ids(spots: DataFrame) -> DataFrame:
    ids = discovered(spots)
    if (ids.stats[0] or 0) <= NARROW:
        ids = F.broadcast(ids)
    return spots.drop("seeds", "tokens").join(ids, "key", "left").withColumn("id", F.expr("coalesce(ids, cast(array() as array<struct<start:int,end:int>>))"))


def extract(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_id, base_sha256, spans) for each row."""
    joined = _with_ids(written(spotted(docs, doc_id, text), "spots"))
    label = "transform({0}, s -> concat('{0}:', s.start, ':', s.end))"
    base = "concat(" + ", ".join(label.format(k) for k, _, _ in KINDS) + ")"
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in [*(k for k, _, _ in KINDS), "id"]]
    return joined.select(F.col("doc_id").alias(doc_id), *counts, F.expr(f"sha2(array_join({base}, ','), 256)").alias("base_sha256"), F.expr(f"array_join(concat({base}, {label.format('id')}), ',')").alias("spans"))


def _replaced(t: str, kinds: list[str]) -> str:
    """Text t with the spans in the columns of these kinds replaced by the kind in brackets, as an expression."""
    marked = "transform({0}, s -> named_struct('start', s.start, 'end', s.end, 'kind', '[{1}]'))"
    spans = "array_sort(concat(" + ", ".join(marked.format(k, k.upper()) for k in kinds) + "))"
    return f"""case when {t} is null then {t} else aggregate({spans}, named_struct('at', 0, 'out', cast(array() as array<string>)),
      (a, s) -> case when s.end <= a.at then a else named_struct('at', s.end, 'out', concat(a.out, array(substring({t}, a.at + 1, greatest(s.start - a.at, 0)), s.kind))) end,
      a -> concat(array_join(a.out, ''), substring({t}, a.at + 1))) end"""


def masked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, all rows and columns, with every span in the text replaced by its kind in brackets.

    Rows are written once with their spans, so that the spans found for a row come back to that
    very row. What is a base match only once its neighbour is replaced goes too, in further
    passes over the rows that have such, until none has.
    """
    kinds = [k for k, _, _ in KINDS]
    spots = written(spotted(docs, doc_id, text, whole=True), "spots")
    joined = _with_ids(spots)
    t = "row.`" + text.replace("`", "``") + "`"
    rows = joined.select("row", F.expr(" + ".join(f"size({k})" for k in [*kinds, "id"]) + " > 0").alias("touched"), F.expr(_replaced(t, [*kinds, "id"])).alias("text"))
    done = []
    while True:
        found = rows.select("row", "text", "touched", *(_matches(e, f"touched and {q}").alias(k) for k, q, e in KINDS))
        found = found.select("row", "text", *(_valid(k).alias(k) for k in kinds))
        out = written(found.select("row", "text", *(F.expr(f"transform({k}, s -> named_struct('start', s.start, 'end', s.end))").alias(k) for k in kinds), F.expr(" + ".join(f"size({k})" for k in kinds) + " > 0").alias("open")), "masked", F.count_if("open"))
        done.append(out.where("not open").select("row", "text"))
        if not out.stats[0]:
            break
        rows = out.where("open").select("row", F.lit(True).alias("touched"), F.expr(_replaced("text", kinds)).alias("text"))
    dropped(spots)
    every = reduce(DataFrame.unionByName, done)
    return every.select(*(F.col("text").alias(c) if c.lower() == text.lower() else F.col("row")[c].alias(c) for c in docs.columns))
