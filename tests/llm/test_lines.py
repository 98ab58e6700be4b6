"""Lines that many documents share, against plain Python."""

from collections import defaultdict

from trialspan.llm import lines

BLANK = " \t\n\v\f\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def expected(rows, least):
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc)
    gone = {k for k, docs in holders.items() if k and len(docs) >= least}
    for doc, text in rows:
        every = (text or "").split("\n")
        kept = [line for line in every if key(line) not in gone]
        yield doc, len(every), len(every) - len(kept), "\n".join(kept)


def check(spark, rows, least=3):
    out = lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), least=least)
    assert out.columns == ["doc_id", "n_lines", "n_dropped", "kept_text"]
    order = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, out.collect()), key=order) == sorted(expected(rows, least), key=order)


def test_threshold_keys_and_positions(spark):
    shared = ["Share THIS", "\t share this \r", "share this", "SHARE this\x0b"]
    rows = [(k, f"first {k}\n{shared[k % 4]}\n\nmiddle\n{shared[(k + 1) % 4]}\nlast {k}") for k in range(3)]
    rows += [(10, "middle"), (11, "share this"), (12, None), (13, ""), (14, "\n\n"), (15, " \xa0"), (16, "ÄRGER"), (17, "ärger"), (18, "Ärger"), (19, "ÄRGER\nÄRGER\nÄRGER")]
    check(spark, rows)
    check(spark, rows, least=2)
    check(spark, rows, least=1)


def test_rows_that_repeat_an_id_are_one_document(spark):
    rows = [(1, "a\nb"), (1, "a\nb"), (1, "a\nc"), (2, "a\nb"), (3, "b"), (None, "c\na"), (None, "c"), (None, "c\nd"), (4, "c")]
    check(spark, rows)
    check(spark, rows, least=2)


def test_odd_rows(spark, odd, odd_rows, empty):
    got = lines.deduplicated(odd, least=2)
    order = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=order) == sorted(expected([r[:2] for r in odd_rows], 2), key=order)
    assert lines.deduplicated(empty).count() == 0


def test_a_line_that_most_documents_hold_is_counted_in_parts(spark):
    rows = [(k, f"everywhere\nown {k}\nin {k % 40}") for k in range(2000)]
    check(spark, rows, least=51)
    check(spark, rows, least=50)
    plan = lines.frequent(spark.createDataFrame(rows, "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan
