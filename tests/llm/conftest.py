"""A small table with every awkward row: nulls, blanks, repeats, ties, a very long text, further columns with clashing names."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, cls long, label string"


def words(rng, n):
    return " ".join(rng.choice(("the", "and", "of", "thon", "edth", "er", "Ing.", "tion,")) + rng.choice(("", "a", "re", "st")) for _ in range(n))


@pytest.fixture(scope="session")
def awkward():
    rng = random.Random(11)
    base = words(rng, 120)
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t ", "en", "a", 6), (4, "word", "en", "a", 4), (None, base, "en", None, 1), (5, base, "en", "a", 1), (5, base, "en", "a", 1),
        (6, base + " tail", "en", "b", 1), (7, base.upper(), "en", "b", 1), (8, "This is under the MIT License. mit license, Apache LICENSE! GNU General Public License v3", "en", "c", 1),
        (9, "été où ça naïve — 中文 123 'tis <|endoftext|> 🙂", "fr", "c", 1), (10, "12 34 !!", "de", "c", 1), (11, words(rng, 30_000), "en", "b", 1), (12, "don't we'll  x\n\ny", "en", "", 1),
        *[(100 + k, words(rng, 40 + k), "en" if k % 2 else "de", "b", 1) for k in range(20)],
    ]
    return [(*r, 0.5, 7, "x") for r in rows]


@pytest.fixture(scope="session")
def docs(spark, awkward):
    return spark.createDataFrame(awkward, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
