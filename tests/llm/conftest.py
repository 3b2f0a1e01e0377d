import datetime

import pytest

WORDS = "alpha beta gamma delta the of and to it is red blue".split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and
    columns whose names clash with those that operators make."""
    long = " ".join(f"{WORDS[i % 12]}{i % 97}" for i in range(20_000))
    rows = [
        (0, "Hello  world", "en", "a"), (1, None, "en", "a"), (2, "", None, "b"), (3, " \t\n", "de", None),
        (None, "no id here", "en", "b"), (5, long, "fr", "a"), (6, long + " x", "fr", "b"), (7, "Hello world", "en", "b"),
        (7, "Hello world", "en", "b"), (8, "x" * 70_000, "en", "c"), (9, "Ünïcode 日本語 🎉 text", None, "c"),
        (None, None, None, None), (None, None, None, None), (10, "He\x0bllo world", "en", "a"), (11, "a b", "en", "a"),
        (12, "<|endoftext|> a  b\n\n c", "en", "\U0001F600"), (13, "�   x", "en", "￿"),
    ]
    day = datetime.date(2024, 1, 1)
    clash = [(*r, 1.5, "own", 7, day, 3) for r in rows]
    return spark.createDataFrame(clash, "doc_id long, text string, lang string, source string, size double, fp string, "
                                        "score long, hash date, shard int").coalesce(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
