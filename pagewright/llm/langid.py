"""Language identification by unigrams over all segmentations.

A language is a distribution over the pieces of a fixed public vocabulary.  The probability of a word is
the sum over all ways of cutting it into pieces of the product of their probabilities; a forward
algorithm sums them without listing them.  The piece probabilities are fitted by expectation
maximisation (forward and backward) on labelled documents.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_rows, id_crc, map_rows, prepare

#: Marks the beginning of a word in the vocabulary.
MARK = "▁"
#: Words up to this length are computed together; longer ones one by one, with rescaling.
TOGETHER = 40
#: Words that one array computation takes.
BLOCK = 2048
#: Probability of a letter that is no piece, relative to the smallest one.
UNKNOWN = 1e-7
#: Sums below this are computed again in logarithms: doubles end near 1e-308, and lose digits before.
FAINT = 1e-280
FIND_WORDS = regex.compile(r"\p{L}+").findall


class Lattice:
    """All pieces that occur in words, found by one Aho-Corasick pass."""

    def __init__(self, vocabulary_path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path)
        pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
        self.pieces = sorted(p for p in pieces if regex.fullmatch(rf"{MARK}?\p{{L}}+|{MARK}", p))
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(self.pieces):
            self.automaton.add_word(p, i << 8 | len(p))
        self.automaton.make_automaton()

    def __len__(self) -> int:
        return len(self.pieces) + 1  # the last one stands for any letter that is no piece

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, start, end, piece) of every edge and the lengths of the marked words.

        Every single letter has an edge, so every word has a segmentation.
        """
        marked = [MARK + w for w in words]
        size = np.array([len(w) for w in marked], np.int64)
        begin = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        joined = "\n".join(marked)
        found = np.fromiter((end << 24 | v for end, v in self.automaton.iter(joined)), np.int64)
        end, piece, length = (found >> 24) + 1, found >> 8 & 0xFFFF, found & 0xFF
        start = end - length
        single = np.zeros(len(joined), bool)
        single[start[length == 1]] = True
        missing = np.ones(len(joined), bool)
        missing[single] = False
        missing[begin[1:] - 1] = False  # the line breaks
        lone = np.flatnonzero(missing)
        start, end = np.concatenate([start, lone]), np.concatenate([end, lone + 1])
        piece = np.concatenate([piece, np.full(len(lone), len(self.pieces))])
        word = np.searchsorted(begin, start, side="right") - 1
        return word, start - begin[word], end - begin[word], piece, size


@lru_cache(maxsize=2)
def lattice(vocabulary_path: str) -> Lattice:
    return Lattice(vocabulary_path)


def _forward(word, start, end, piece, size, probability, logs=False):
    """Sums of all segmentations that reach each position, one row for each word and language.

    With ``logs``, ``probability`` and the result are logarithms, which do not underflow.
    """
    n, langs = len(size), probability.shape[1]
    times, plus = (np.add, np.logaddexp) if logs else (np.multiply, np.add)
    reach = np.full((n, int(size.max()) + 1, langs), -np.inf if logs else 0.0)
    reach[:, 0] = 0 if logs else 1
    order = np.lexsort((word, end))
    word, start, end, piece = word[order], start[order], end[order], piece[order]
    bounds = np.searchsorted(end, np.arange(reach.shape[1] + 1))
    for at in range(1, reach.shape[1]):
        a, b = bounds[at], bounds[at + 1]
        if a == b:
            continue
        own = word[a:b]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        reach[own[first], at] = plus.reduceat(times(reach[own, start[a:b]], probability[piece[a:b]]), first, axis=0)
    return reach


def _faint(whole: np.ndarray) -> np.ndarray:
    """The words whose sum is too small for plain doubles in some language.

    No sum exceeds 1, so what underflows on the way cannot add more than that to a sum that is not faint.
    """
    return np.flatnonzero((whole < FAINT).any(axis=1))


def word_scores(words: list[str], vocabulary: Lattice, probability: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language."""
    out = np.empty((len(words), probability.shape[1]))
    short = [i for i, w in enumerate(words) if len(w) <= TOGETHER]
    for at in range(0, len(short), BLOCK):
        own = short[at : at + BLOCK]
        *edges, size = vocabulary.edges([words[i] for i in own])
        whole = _forward(*edges, size, probability)[np.arange(len(own)), size]
        faint = _faint(whole)
        whole[faint] = 1
        out[own] = np.log(whole)
        if len(faint):
            *edges, size = vocabulary.edges([words[own[i]] for i in faint])
            reach = _forward(*edges, size, np.log(probability), logs=True)
            out[[own[i] for i in faint]] = reach[np.arange(len(faint)), size]
    for i, w in enumerate(words):
        if len(w) > TOGETHER:
            out[i] = _long_word(w, vocabulary, probability)
    return out


def _long_word(word: str, vocabulary: Lattice, probability: np.ndarray) -> np.ndarray:
    """The same sum for a word of any length: logarithms of the scale are kept beside the values."""
    _, start, end, piece, size = vocabulary.edges([word])
    order = np.argsort(end, kind="stable")
    start, end, piece = start[order], end[order], piece[order]
    bounds = np.searchsorted(end, np.arange(int(size[0]) + 2))
    logs = np.full((int(size[0]) + 1, probability.shape[1]), -np.inf)
    logs[0] = 0
    log_p = np.log(probability)
    for at in range(1, len(logs)):
        a, b = bounds[at], bounds[at + 1]
        logs[at] = np.logaddexp.reduce(logs[start[a:b]] + log_p[piece[a:b]], axis=0)
    return logs[-1]


def _expected(words: list[str], counts: np.ndarray, vocabulary: Lattice, probability: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece, by word counts of each language."""
    total = np.zeros_like(probability)
    log_p = np.log(probability)

    def add(own: list[str], n: np.ndarray) -> None:
        word, start, end, piece, size = vocabulary.edges(own)
        ahead = _forward(word, start, end, piece, size, probability)
        # Backward sums are forward sums of the mirrored words.
        back = _forward(word, size[word] - end, size[word] - start, piece, size, probability)
        whole = ahead[np.arange(len(own)), size]
        faint = _faint(whole)
        whole[faint] = np.inf  # their uses are added in logarithms
        _add_uses(total, piece, ahead[word, start] * probability[piece] * back[word, size[word] - end] / whole[word] * n[word])
        if len(faint):
            add_faint([own[i] for i in faint], n[faint])

    def add_faint(own: list[str], n: np.ndarray) -> None:
        word, start, end, piece, size = vocabulary.edges(own)
        ahead = _forward(word, start, end, piece, size, log_p, logs=True)
        back = _forward(word, size[word] - end, size[word] - start, piece, size, log_p, logs=True)
        whole = ahead[np.arange(len(own)), size]
        use = np.exp(ahead[word, start] + log_p[piece] + back[word, size[word] - end] - whole[word])
        _add_uses(total, piece, use * n[word])

    short = [i for i, w in enumerate(words) if len(w) <= TOGETHER]
    for at in range(0, len(short), BLOCK):
        part = short[at : at + BLOCK]
        add([words[i] for i in part], counts[part])
    for i, w in enumerate(words):
        if len(w) > TOGETHER:
            add_faint([w], counts[i : i + 1])
    return total


def _add_uses(total: np.ndarray, piece: np.ndarray, use: np.ndarray) -> None:
    for k in range(total.shape[1]):
        total[:, k] += np.bincount(piece, use[:, k], minlength=len(total))


@dataclass
class LanguageModel:
    """Languages in alphabetical order and the probability of each piece in each of them."""

    languages: list[str]
    probability: np.ndarray
    vocabulary_path: str


def fit_texts(samples: list[tuple[str, str]], vocabulary_path: str, rounds: int = 3, smooth: float = 0.1) -> LanguageModel:
    """Fit on (language, text) pairs; no pairs give a model without languages."""
    languages = sorted({lang for lang, _ in samples})
    vocabulary = lattice(vocabulary_path)
    counters = {lang: Counter() for lang in languages}
    for lang, text in samples:
        counters[lang].update(FIND_WORDS(text.lower()))
    words = list(dict.fromkeys(w for c in counters.values() for w in c))
    counts = np.array([[counters[lang][w] for lang in languages] for w in words], float).reshape(len(words), len(languages))
    probability = np.full((len(vocabulary), len(languages)), 1 / len(vocabulary))
    for _ in range(rounds if words else 0):
        use = _expected(words, counts, vocabulary, probability) + smooth
        use[-1] = UNKNOWN
        probability = use / use.sum(axis=0)
    return LanguageModel(languages, probability, vocabulary_path)


def fit(
    docs: DataFrame,
    train: object | None = None,
    per_language: int = 300,
    longest_text: int = 1 << 14,
    vocabulary_path: str | None = None,
) -> LanguageModel:
    """Fit on a bounded sample of the labelled documents.

    The bound: about ``per_language`` documents of each language, chosen by a hash of the id, of texts up
    to ``longest_text`` bytes.  ``train`` (a column condition) further limits the rows; by default those
    whose crc32(doc_id) mod 4 is not 2.
    """
    path = vocabulary_path or public_tokenizers.path("piece_bpe_32k.model")
    train = F.pmod(id_crc(), F.lit(4)) != 2 if train is None else train
    rows = docs.filter(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.withColumn("_lot", F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = F.lit(False)
    for lang, n in counts.items():
        chosen = chosen | ((F.col("lang") == lang) & (F.col("_lot") < math.ceil(per_language * 1e6 / n)))
    sample = rows.filter(chosen & (F.octet_length("text") <= longest_text)).select("doc_id", "lang", "text").collect()
    sample.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"], r["text"]))
    return fit_texts([(r["lang"], r["text"]) for r in sample], path)


class _Scorer:
    """Word scores that a worker remembers, in two generations.

    When the young one is full it becomes the old one, and words that still occur move over.
    """

    def __init__(self, model: LanguageModel, keep: int = 120_000):
        self.model, self.keep = model, keep
        self.vocabulary = lattice(model.vocabulary_path)
        self.young = self._empty(keep)
        self.old = self._empty(0)

    def _empty(self, rows: int) -> tuple[dict[str, int], np.ndarray]:
        return {}, np.empty((rows, len(self.model.languages)))

    def _know(self, wanted: set[str]) -> None:
        """Have every word of ``wanted`` in the young generation."""
        place, scores = self.young
        missing = [w for w in wanted if w not in place]
        if len(place) + len(missing) > len(scores):
            self.old, self.young = self.young, self._empty(max(self.keep, len(wanted)))
            place, scores = self.young
            missing = list(wanted)
        old_place, old_scores = self.old
        moved = [w for w in missing if w in old_place]
        fresh = [w for w in missing if w not in old_place] if moved else missing
        for words, rows in ((moved, old_scores[[old_place[w] for w in moved]] if moved else None), (fresh, None)):
            if words:
                at = len(place)
                scores[at : at + len(words)] = word_scores(words, self.vocabulary, self.model.probability) if rows is None else rows
                place.update(zip(words, range(at, at + len(words))))

    def totals(self, texts: list[str]) -> list[np.ndarray | None]:
        """Log probability of each text in each language; None without letters."""
        split = [FIND_WORDS(t.lower()) for t in texts]
        self._know(set().union(*split))
        place, scores = self.young
        return [scores[[place[w] for w in words]].sum(axis=0) if words else None for words in split]


def identify(docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every whole text.

    The score is the posterior of the predicted language under equal priors.  Null texts and texts without
    a letter, and all texts if the model has no language, are ``und`` with score 0.  Ties go to the
    language first in the alphabet.  Repeated rows are kept; other columns are ignored.
    """
    prepare(docs.sparkSession)

    def make():
        scorer = _Scorer(model)

        def work(batch):
            found = scorer.totals([t or "" for t in batch["text"]]) if model.languages else [None] * len(batch["text"])
            names, scores = [], []
            for total in found:
                if total is None:
                    names.append("und")
                    scores.append(0.0)
                    continue
                best = int(total.argmax())
                names.append(model.languages[best])
                scores.append(float(1 / np.exp(total - total[best]).sum()))
            return {"doc_id": batch["doc_id"], "lang_pred": names, "score": scores}

        return work

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return map_rows(rows, make, "doc_id long, lang_pred string, score double", rows=128)


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` that are not ``und`` and score at least this much; columns unchanged.

    Null texts, texts without a letter and, if the model has no language, all texts go.  Rows with a null id and
    repeated rows are judged by their text like all others; an empty table stays empty.
    """
    prepare(docs.sparkSession)

    def make():
        scorer = _Scorer(model)

        def passes(texts: list[str | None]) -> list[bool]:
            found = scorer.totals([t or "" for t in texts]) if model.languages else [None] * len(texts)
            return [t is not None and bool(1 / np.exp(t - t.max()).sum() >= least) for t in found]

        return passes

    return filter_rows(docs, make, "text")
