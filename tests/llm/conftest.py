import random

import pytest

WORDS = "the of and to in is that it was for on with as his they be at one have this from or had by".split()


def prose(rng, words):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "ing", "er"]) for _ in range(words))


@pytest.fixture(scope="session")
def hard_docs(spark):
    """Documents with nulls in every column, empty and very long texts, repeated rows and clashing names."""
    rng = random.Random(11)
    base = prose(rng, 60)
    rows = [
        (1, base, "en", "a", 10, 1, 1),
        (2, base, "en", "a", 10, 1, 1),
        (2, base, "en", "a", 10, 1, 1),
        (3, base + " more", None, None, None, None, None),
        (4, None, "en", "a", None, 2, 2),
        (5, "", "en", "b", 0, 2, 2),
        (6, " \n\t ", "en", "b", 0, 2, 2),
        (None, base, "en", "b", 5, 3, 3),
        (None, None, None, None, None, None, None),
        (7, prose(rng, 30_000), "en", "hot", 9, 4, 4),
        (8, "Ünïcode ▁ text 中文 😀\x00 end", "de", "c", 9, 4, 4),
        (9, "one", "de", "c", 9, 4, 4),
        *[(100 + i, prose(rng, rng.randint(1, 300)), "en", "hot", 1, i, i) for i in range(60)],
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars int, row long, key long"
    return rows, spark.createDataFrame(rows, schema).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars int, row long, key long"
    return spark.createDataFrame([], schema)
