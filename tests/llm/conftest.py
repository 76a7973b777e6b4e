import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string, size int, score double, _text string, root long"


def words(rng, n, stem="w"):
    return " ".join(f"{stem}{rng.randint(0, 300)}" for _ in range(n))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, extra columns with names that operators use."""
    rng = random.Random(5)
    long = words(rng, 60_000)
    base = words(rng, 400)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, base.replace("w7 ", "x "), "en", "b"),
        (4, None, "en", "a"), (5, "", None, "b"), (6, " \t\n", "fr", None), (7, long, "en", "a"), (8, long + " end", "en", "a"),
        (None, base, "en", "c"), (None, None, None, None), (9, "One", "de", "c"), (10, "one", "de", "c"), (11, "a b", "de", "a"),
        (None, "only without an id " * 30, "en", "a"), (None, "only without an id " * 30, "en", "a"), (12, "é ü  ﬀ <|endoftext|>", "x", "b"),
    ]
    rows += [(20 + i, words(rng, 120), ("en", "fr")[i % 2], f"s{i % 4}") for i in range(40)]
    full = [(*r, None if r[1] is None else len(r[1]), 1, "k", 2, 0.5, "t", 3) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty_docs(edge_docs):
    return edge_docs.limit(0)
