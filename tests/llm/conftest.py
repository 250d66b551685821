"""Small document tables with everything odd in them."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators might use themselves.
CLASHES = ("h", "pos", "size", "bucket", "gram", "c", "rid", "doc", "comp", "fp", "b", "w", "start", "ids", "__id", "__cut", "__leak", "__gone", "__letter", "key", "ref")


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}x" for _ in range(n)]


def table(spark, rows, clashes: bool = False):
    df = spark.createDataFrame([(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in rows], SCHEMA)
    if clashes:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("clash") for c in CLASHES})
    return df


@pytest.fixture
def odd_rows():
    """Nulls in every column, empty and blank texts, repeated rows, ties and a very long text."""
    rng = random.Random(1)
    long = " ".join(words(rng, 30_000, 20_000))
    return [
        (1, "Plain text of a few words. And more of it!", "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, None),
        (4, " \n\t \n", "de", "b"),
        (None, "A text without an id.", "en", "a"),
        (6, "same same same same same same", "en", "a"),
        (6, "same same same same same same", "en", "a"),
        (7, long, "en", "b"),
        (8, "日本語 ▁ ▁ 😀 é́ \0 x", "fr", "b"),
    ]
