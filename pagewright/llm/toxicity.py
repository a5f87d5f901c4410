"""Toxicity by a weighted lexicon.

Texts are folded first: lower case, accents and look-alike letters to plain Latin, digits and signs that
stand for letters to those letters.  One Aho-Corasick pass finds lexicon entries (whole words, or word
beginnings) and exception phrases; an entry inside an exception phrase does not count.  The sum of the
weights is normalised by the length of the text and turned into a probability.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_rows, id_crc, map_rows, prepare

# Letters of other scripts that look like Latin ones, and what they look like.
LOOK_ALIKE = dict(zip("авекмнорстухіѕјԁһԛԝɡαεικνορτυχ", "abekmhopctyxisjdhqwgaeikvoptux"))
# Digits and signs that stand for letters.  As 1 and | stand for both i and l, those two are one letter.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "|": "i", "l": "i"}
INVISIBLE = "­​‌‍⁠﻿"


def _fold_table() -> dict[int, str]:
    table = {}
    for c in range(0xC0, 0x250):  # accented Latin letters to their base letters
        base = unicodedata.normalize("NFD", chr(c))[0].lower()
        if base.isascii() and base.isalpha():
            table[c] = base
    for c in range(26):
        table[0xFF21 + c] = table[0xFF41 + c] = chr(ord("a") + c)
    for c in range(10):
        table[0xFF10 + c] = str(c)
    table |= {ord(a): b for a, b in LOOK_ALIKE.items()}
    table |= {ord(c): "" for c in INVISIBLE}
    table |= {c: "" for c in range(0x300, 0x370)}  # combining marks
    for c, b in list(table.items()):
        table[c] = STANDS_FOR.get(b, b)
    return table | {ord(a): b for a, b in STANDS_FOR.items()}


FOLD = _fold_table()
FIND_WORDS = regex.compile(r"\p{L}+").findall


def folded_words(text: str) -> list[str]:
    """The words of a text after folding."""
    return FIND_WORDS(text.lower().translate(FOLD))


@dataclass
class Lexicon:
    """Entries ``" word "`` (a whole word) or ``" begin"`` (a word beginning) with weights, exception phrases
    ``" one two "``, and the line that turns the normalised sum into a log odds."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    slope: float = 1.0
    intercept: float = -20.0


class Matcher:
    """The automaton of a lexicon."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        for phrase in lexicon.exceptions:
            self.automaton.add_word(phrase, (len(phrase), None))
        for entry, weight in lexicon.weights.items():
            self.automaton.add_word(entry, (len(entry), weight))
        if len(self.automaton):
            self.automaton.make_automaton()

    def total(self, words: list[str]) -> float:
        """Sum of the weights of the entries that no exception phrase covers, normalised by length."""
        if not words or not len(self.automaton):
            return 0.0
        hits, spared = [], []
        for end, (n, weight) in self.automaton.iter(f" {' '.join(words)} "):
            (spared if weight is None else hits).append((end + 1 - n, end + 1, weight))
        s = sum(w for a, b, w in hits if not any(x <= a and b <= y for x, y, _ in spared))
        return s / math.log2(16 + len(words))

    def score(self, words: list[str]) -> float:
        x = self.lexicon.slope * self.total(words) + self.lexicon.intercept
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def _forms(word: str) -> list[str]:
    """The word as an entry, and its beginnings."""
    return [f" {word} ", *(" " + word[:k] for k in (4, 5, 6) if len(word) > k)]


def _entries(docs: list[tuple[list[str], int]], share: float, least: float, times: float) -> dict[str, float]:
    """Words and word beginnings that are far commoner in toxic documents, with their log odds.

    An entry needs toxic documents and also that many different neighbourhoods (the words on both sides),
    so the accidental words of a toxic text with many near copies do not get in.  At the corpus's own
    ``share`` of toxic documents, four of five documents that have an entry must be toxic.
    """
    n = Counter(y for _, y in docs)
    few = max(5.0, least * n[1])
    every = Counter(e for words, y in docs if y for e in {e for w in set(words) for e in _forms(w)})
    # Only forms that enough toxic documents have are counted any further.
    bad = {e: c for e, c in every.items() if c >= few}
    longest: dict[str, int] = {}  # of the words that a beginning stands for, how common the commonest is
    for e, c in every.items():
        if e[-1] == " ":
            for k in (4, 5, 6):
                if len(e) - 2 > k:
                    longest[e[: k + 1]] = max(longest.get(e[: k + 1], 0), c)
    del every
    good: Counter = Counter()
    around: dict[str, set] = {}
    for words, y in docs:
        if y:
            for one, w, two in zip(["", *words], words, [*words[1:], ""]):
                for e in _forms(w):
                    if e in bad:
                        around.setdefault(e, set()).add((one, two))
        else:
            good.update({e for w in set(words) for e in _forms(w) if e in bad})
    passing = {
        e: c
        for e, c in bad.items()
        if c / n[1] >= times * (good[e] + 0.5) / n[0]
        and c >= 4 * good[e]
        and len(around[e]) >= few
    }
    whole = {e: c for e, c in passing.items() if e[-1] == " "}
    # A beginning counts if it stands for many words; of nested ones the commonest, then the longest.
    begins: list[str] = []
    for e in sorted((e for e in passing if e[-1] != " "), key=lambda e: (-passing[e], -len(e), e)):
        if passing[e] >= 1.5 * longest.get(e, 0) and not any(e.startswith(b) or b.startswith(e) for b in begins):
            begins.append(e)
    chosen = [*begins, *(e for e in whole if not any(e.startswith(b) for b in begins))]

    def odds(c: int, total: int) -> float:
        return math.log((c + 0.5) / (total - c + 0.5))

    weights = {e: odds(bad[e], n[1]) - odds(good[e], n[0]) for e in sorted(chosen)}
    return {e: w for e, w in weights.items() if w + math.log(share / (1 - share)) >= math.log(4)}


def _exceptions(docs: list[tuple[list[str], int]], weights: dict[str, float], least: int) -> list[str]:
    """Pairs of neighbouring words around an entry that (nearly) only clean documents have."""
    seen = {0: Counter(), 1: Counter()}
    words_only = {e.strip() for e in weights if e[-1] == " "}
    begins = tuple(e[1:] for e in weights if e[-1] != " ")
    for words, y in docs:
        own = set()
        for i, w in enumerate(words):
            if w in words_only or (begins and w.startswith(begins)):
                if i:
                    own.add(f" {words[i - 1]} {w} ")
                if i + 1 < len(words):
                    own.add(f" {w} {words[i + 1]} ")
        seen[y].update(own)
    return sorted(p for p, c in seen[0].items() if c >= least and seen[1][p] * 10 <= c)


def _line(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on one number, by Newton's steps with a little ridge."""
    z = np.stack([x, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    ridge = np.diag([1e-2, 1e-4])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (weight * (p - y)) + ridge @ w
        bend = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge
        w = w - np.clip(np.linalg.solve(bend, slope), -5, 5)
    return float(w[0]), float(w[1])


def fit_texts(
    samples: list[tuple[str, int]], share: float | None = None, least: float = 0.006, times: float = 8.0
) -> Lexicon:
    """Fit on (text, toxic) pairs; equal texts count once.  ``share`` is the share of toxic documents.

    Without both classes the lexicon is empty and every score is nearly 0.
    """
    split = [(folded_words(t), y) for t, y in dict(samples).items()]
    n = Counter(y for _, y in split)
    if not n[0] or not n[1]:
        return Lexicon()
    share = min(max(n[1] / len(split) if share is None else share, 1e-4), 1 - 1e-4)
    weights = _entries(split, share, least, times)
    lexicon = Lexicon(weights, _exceptions(split, weights, least=3))
    matcher = Matcher(lexicon)
    x = np.array([matcher.total(w) for w, _ in split])
    y = np.array([y for _, y in split], float)
    weight = np.where(y == 1, share * len(split) / n[1], (1 - share) * len(split) / n[0])
    lexicon.slope, lexicon.intercept = _line(x, y, weight)
    return lexicon


def fit(
    docs: DataFrame,
    labels: DataFrame,
    train: object | None = None,
    toxic_rows: int = 1500,
    clean_rows: int = 3000,
    longest_text: int = 1 << 14,
) -> Lexicon:
    """Fit on a bounded sample of the labelled documents.

    The bound: about ``toxic_rows`` and ``clean_rows`` documents, chosen by a hash of the id, of texts up to
    ``longest_text`` bytes.  ``train`` (a column condition on ``doc_id``) limits the rows; by default those
    whose crc32(doc_id) mod 5 is not 0.  A document with both labels counts as toxic.
    """
    train = F.pmod(id_crc(), F.lit(5)) != 0 if train is None else train
    rows = (
        labels.filter(train & F.col("toxic").isNotNull())
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
        .withColumn("_lot", F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)))
    )
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return Lexicon()
    most = F.when(F.col("toxic") == 1, math.ceil(toxic_rows * 1e6 / n[1])).otherwise(math.ceil(clean_rows * 1e6 / n[0]))
    chosen = rows.filter(F.col("_lot") < most).select("doc_id", "toxic")
    texts = docs.filter(F.col("text").isNotNull() & (F.octet_length("text") <= longest_text)).select("doc_id", "text")
    # The chosen ids are bounded by the two parameters, so they may be broadcast.
    sample = texts.join(F.broadcast(chosen), "doc_id").collect()
    sample.sort(key=lambda r: (r["doc_id"], r["text"]))
    return fit_texts([(r["text"], r["toxic"]) for r in sample], n[1] / (n[0] + n[1]))


def score(docs: DataFrame, lexicon: Lexicon, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for every whole text.

    Null and empty texts score as texts without any entry.  Repeated rows are kept; other columns are
    ignored.
    """
    prepare(docs.sparkSession)

    def make():
        matcher = Matcher(lexicon)

        def work(batch):
            found = [matcher.score(folded_words(t or "")) for t in batch["text"]]
            return {"doc_id": batch["doc_id"], "score": found, "predicted": [int(s >= 0.5) for s in found]}

        return work

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return map_rows(rows, make, "doc_id long, score double, predicted int", rows=256)


def keep_clean(docs: DataFrame, lexicon: Lexicon, below: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold; columns unchanged.

    Null and empty texts have the score of a text without entries, so they stay.  Rows with a null id and repeated
    rows are judged by their text like all others; an empty table stays empty.
    """
    prepare(docs.sparkSession)

    def make():
        matcher = Matcher(lexicon)
        return lambda texts: [matcher.score(folded_words(t or "")) < below for t in texts]

    return filter_rows(docs, make, "text")
