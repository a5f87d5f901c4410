"""A shared folder for the session's written tables, and odd inputs for every operator."""

from __future__ import annotations

import pytest

TEXTS = [
    "the quick brown fox jumps over the lazy dog and runs away",
    "The  quick brown fox jumps over the lazy dog and runs away",
    "",
    None,
    "é" * 3000,
    "<|endoftext|> x <|startoftext|>",
    "numbers 123 ² ① and 中文 🙂 z\x00\x1f\x85",
    "word " * 5000,
    "   \n\t ",
    "İstanbul ΣΑΣ ßß",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with null and repeated ids, null and empty and long texts, ties, and columns whose names clash."""
    rows = [(i, t, "en" if i % 2 else None, i, "x", 1.0, 7, b"b") for i, t in enumerate(TEXTS)]
    rows += [(3, "again", None, 1, "y", 2.0, 8, b"c"), (None, "no id here", "de", 1, "z", 3.0, 9, b"d"), (0, TEXTS[0], "en", 0, "x", 1.0, 7, b"b")]
    schema = "doc_id long, text string, lang string, length int, piece string, score double, kind int, media binary"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("1 = 0")
