import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, size long, words string, __id string, __th int, label int, fp string, low string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in any column, empty and very long texts, ties, repeated rows, and
    further columns whose names the operators use themselves."""
    r = random.Random(11)
    vocabulary = ["the", "of", "and", "river", "stone", "garden", "you", "idiot", "paper", "light", "water", "house"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base = text(120)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, base + " extra", "en", "b"), (4, None, "en", "b"), (5, "", None, None),
        (None, text(80), "en", "a"), (None, text(80), "en", None), (6, text(30_000), "en", "c"), (7, " \n\t ", "en", "c"), (8, "# MIT License\n" + text(60), "xx", "a"),
        (9, text(40) + "\n" + base + "\n" + text(40), "en", "b"), (10, base.upper() + " !!!", "en", "c"), (11, "$$$ *** ### " * 40 + "<|endoftext|> <|startoftext|>", "en", "a"), (12, "日本語 🙂 ünï\x00", "ja", "é"), (12, "other text of the same id", "en", "b"),
    ]
    return spark.createDataFrame([(*x, None, "h", 1, "w", "i", 2, 0, "f", "l") for x in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where(F.lit(False))
