import random

import pytest

LANGS = {"en": "the of and to in is that for with tion ing er on ha".split(), "de": "der die und ein ung heit schen mit ist zu ge be für".split()}


def prose(rng: random.Random, n: int, lang: str = "en") -> str:
    """n words made of syllables."""
    base = LANGS[lang]
    return " ".join("".join(rng.choice(base) for _ in range(rng.choice((1, 1, 2, 3)))) for _ in range(n))


def corpus(n: int = 60, seed: int = 1) -> list[tuple]:
    """(doc_id, text) with copies, near copies, shared lines, empty and null texts, and a long one."""
    rng = random.Random(seed)
    shared = [prose(rng, 14) for _ in range(3)]
    rows = []
    for i in range(n):
        text = prose(rng, rng.choice((1, 3, 20, 60, 150)), rng.choice(("en", "en", "de")))
        if i % 5 == 0:
            text += "\n" + rng.choice(shared) + "\n" + prose(rng, 5)
        if rows and i % 7 == 0:
            text = rng.choice(rows)[1] or text
        if rows and i % 11 == 0:
            text = (rows[-1][1] or "x") + " end"
        rows.append((i * 3, text))
    rows += [(1, None), (4, ""), (7, " \n\t "), (10, "Ünïcødé — 漢字 é̂"), (13, prose(rng, 4000)), (1000, shared[0]), (1003, "word " * 300)]
    return rows


CLASH = ["__text", "fp", "id", "w", "h", "n", "x", "key", "score", "bucket", "node", "row"]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string")


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and texts, a repeated row, and columns with names that operators use inside."""
    rows = [(None, "same text here for all", "de"), (5, None, None), (5, "same text here for all", "en"), (5, "same text here for all", "en"), (2, "", "en"), (9, "other words stand in this one", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("z") for c in CLASH})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
