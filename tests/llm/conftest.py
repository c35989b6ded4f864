import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, n int"
WORDS = [a + b + c for a in ("th", "er", "on", "ka", "mi", "zu") for b in ("an", "el", "or") for c in ("", "s", "ing", "ed")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def rng():
    return random.Random(5)


@pytest.fixture(scope="session")
def edge_rows(rng):
    """Nulls in any column, empty and very long texts, repeated rows and odd white space."""
    long = prose(rng, 30_000)
    same = prose(rng, 60)
    texts = [None, "", "   \n\t ", "one", "a b c d", same, same, same.upper(), long, long + " tail", "x" * 50_000, "é à ñ 日本 語。 end", "<|endoftext|> a  b\n\n\nc", prose(rng, 40) + "\n" + prose(rng, 40), "# * $ % & | < >", "a\n" * 30]
    rows = [(k, t, "en" if k % 2 else None, None if k % 3 else "src", None, 0.5, 7, 1) for k, t in enumerate(texts)]
    rows += [rows[5], (None, same, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
