import random

import pytest


@pytest.fixture(scope="session")
def edge(spark):
    """Rows that are awkward: nulls, empty, blank, very long, no blanks, repeated, odd characters; extra columns with clashing names."""
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "omega", "the", "of", "and", "to", "in"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 400)) for _ in range(n))
    same = prose(120)
    rows = [
        (1, None, "en"),
        (2, "", "en"),
        (3, " \n\t \x0b\r\n", None),
        (4, prose(20_000), "en"),
        (5, "x" * 60_000, "en"),
        (6, same, "en"),
        (7, same, "en"),
        (8, same, "xx"),
        (8, same, "xx"),
        (None, "one two three", "en"),
        (None, None, None),
        (9, "one two", "de"),
        (10, "one two", "de"),
        (11, "9" * 40_000 + " " + "a@" * 3000 + "1." * 5000, "fr"),
        (12, "日本語 \U0001f600   é <|endoftext|> it's 's\n\n", ""),
        (13, "same line\n" * 3000, "es"),
        (14, "ÀÉ " * 200 + "+" * 5000, "fr"),
    ]
    data = [(i, t, lang, "src", None if t is None else len(t), 0.5, True, [1], "r", 3) for i, t, lang in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, ids array<int>, row string, part int").repartition(3)
