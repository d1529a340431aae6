from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, size long, label string, score double, words int, lines int, _spans string, _words int, _row int, quality int, _text_key long, _n int, target string"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows that every operator must stand: nulls, empty, blank and very long texts, repeats, ties, and extra columns."""
    long = "Lorem ipsum dolor. " * 20_000
    texts = [(1, "the of and the"), (2, None), (3, ""), (4, " \t\n "), (5, long), (6, "the of and the"), (6, "the of and the"), (None, "no id here but words"), (7, "1234"), (8, "\x1c\x00é<|endoftext|> x@y.zz"), (None, None)]
    rows = [(i, t, None if n % 3 else "en", None if n % 4 == 0 else "s", None, "k", 1, "l", 0.5, n, n, "s", n, n, n, n, n, "t") for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
