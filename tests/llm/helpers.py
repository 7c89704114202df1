"""Rows shared by the tests of the text operators."""

from __future__ import annotations

import random

#: Nulls in every column, empty and white texts, repeated rows, ties, odd code points, a special string, a long word and a long text.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog and runs away\n", "en"),
    (1, "the quick brown fox jumps over the lazy dog and runs away\n", "en"),
    (2, "The QUICK brown fox jumps over the lazy dog and runs away", None),
    (3, None, "en"),
    (4, "", "fr"),
    (5, " \t\n\x0b\x0c\r ", "de"),
    (None, "a row without an id, with words enough for several shingles in it", "en"),
    (None, None, None),
    (6, "one", "en"),
    (7, "naïve Ænglish ß 漢字 😀 ՘ \x1c\x85 <|endoftext|> don't we'll 12345 ...", "de"),
    (8, "x" * 5000, "en"),
    (9, " ".join(f"w{i % 977}" for i in range(60_000)), "en"),
]


def rows(spark, data=ODD, extra: bool = True):
    """The rows as a table, with extra columns that carry the names of outputs."""
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    if extra:
        df = df.selectExpr("*", "'x' AS fingerprint", "1 AS ids", "2 AS score", "3 AS n_tokens", "4 AS component_id", "'k' AS key", "5 AS predicted")
    return df


def prose(seed: int, n: int, words: int = 400, vocabulary: int = 600) -> list[str]:
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(vocabulary)]
    return [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, words))) for _ in range(n)]
