"""Small documents with every awkward case: nulls, empty texts, ties, repeats, long texts, clashing column names."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def cases() -> list[tuple]:
    r = random.Random(5)
    vocab = ["Ab", "ab", "c,", "été", "x#y", "d|e", "f!", "日本", "gh", "i*"]
    rows = [(i, " ".join(r.choices(vocab, k=r.choice([0, 1, 3, 4, 5, 12, 60]))) + r.choice(["", "\n", " \t"]), r.choice(["en", "fr", None]), r.choice(["s1", "s2", "S3", None]), 1) for i in range(60)]
    long = " ".join(r.choices(vocab, k=6000))
    rows += [(60, long, "en", "s1", 1), (61, long.upper(), "en", "s1", 1), (62, long + " tail", "en", "s2", 1), (63, None, None, None, None), (64, "", "en", "s1", 0)]
    rows += [(65, "x" * 5000, "en", "s1", 1), (66, "same line\nsame line\nother\nsame line", "en", "s1", 1), (67, "\x0b\x0c \x1c a b c", "fr", "s2", 1)]
    rows += [rows[10], rows[10], (None, "a null identifier has this text here", "en", "s1", 1), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(cases(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
