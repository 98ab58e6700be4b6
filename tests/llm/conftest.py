import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id long"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows, and further columns with clashing names."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeénü") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = prose(70)
    base = prose(200)
    texts = [
        None, "", "   \n\t ", "one", "two words", "12 34 !!", "x" * 3000, prose(20000), base, base,
        base.replace(" ", "  ", 1), base + " more", passage, prose(60) + " " + passage + " " + prose(60), prose(40) + " " + passage, prose(9),
        "call +1 (555) 010-9999 or mail a.b@c.example.org, ip 10.0.0.1, card 4111 1111 1111 1111",
        "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.", "a\na\na\nb\n\n\nb", "the the the the the the",
        "Ünïcödé wörds änd emoji \U0001f600 here", prose(300).upper(), base.upper(),
    ]
    rows = [(k, t, ["en", "fr", None, ""][k % 4], None if k % 5 == 0 else "s", None, 0.5, 99 - k) for k, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, base, "en", "s", 1, 0.0, 1), (None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
