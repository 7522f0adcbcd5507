import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _t string, id string, key string, n string, h string, _doc string, _s string, size string, ids string"


def frame(spark, rows):
    """Documents from (doc_id, text[, lang[, source]]), with further columns named like the operators' own."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), *["x"] * 10) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return lambda rows: frame(spark, rows)


def prose(seed, n, alphabet="etaoinshr"):
    r = random.Random(seed)
    return " ".join("".join(r.choices(alphabet, k=r.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, one word, ties, repeated rows, a very long text, and rows without id."""
    long = prose(1, 60_000)
    body = prose(2, 80)
    return [
        (1, None), (2, ""), (3, " \t\n\x0b"), (4, "word"), (5, body), (6, body), (6, body), (7, long), (8, long + " end"), (None, body), (None, None),
        (9, "ünïcödé Ünïcödé\n\nÜNÏCÖDÉ   \x00 \U0001f600"), (10, "x" * 50_000), (11, None, None, None), (12, body + "\n" + body, None, None),
    ]
