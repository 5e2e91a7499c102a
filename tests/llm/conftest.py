import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, run int, bag_id string, __source string, kind string"
WORDS = "the of and a in to er ing on an re at or en nd ti es ed is it he ha ou ea hi st nt".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4))) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, repeated rows and ids, columns with clashing names."""
    rng = random.Random(5)
    base = [prose(rng, 80) for _ in range(12)]
    texts = [*base, base[0], base[0] + " tail", base[1].upper(), None, "", " ", "###", "x", "été ß 日本語 日本", prose(rng, 30_000), "a" * 70_000, "1d10t " * 50, "😀" * 40, "<|endoftext|> a", "line\nline\n" * 30]
    rows = [(i, t, ("en", "de", None)[i % 3], ("s0", "s0", "s1", None)[i % 4], None if t is None else len(t), 0.5, 1, "x", "y", "z") for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, None, None, None, None, None, None, None, None, None), (None, base[2], "en", "s2", 1, None, None, None, None, None), (4, base[5], "en", "s0", 1, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(30)] + [(None, 1, 1), (3, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int")
