"""Offline spell correction: token lookup by a delete-neighbourhood join, runs, compound lookup, hit rate."""

from __future__ import annotations

import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import text as X
from ..scratch import broadcast_if_small, kept
from .layout import runs

# Greatest edit distance, indexed prefix, languages that are corrected word by word.
DISTANCE, PREFIX = 2, 7
#: Most words of a dictionary that every worker holds in memory.
MOST_WORDS = 2_000_000
WORD_BY_WORD = ("gu", "mr")


def delete_neighbours(word: Column, distance: int = DISTANCE, prefix: int = PREFIX) -> Column:
    """All strings that arise from the word's prefix by at most ``distance`` deletions, itself included."""
    out = F.array(F.substring(word, 1, prefix))
    for _ in range(distance):
        shorter = F.flatten(
            F.transform(
                out,
                lambda w: F.transform(
                    F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))),
                    lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))),
                ),
            )
        )
        out = F.array_distinct(F.concat(out, shorter))
    return out


def suggestions(words: DataFrame, dictionary: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """For each distinct ``word`` (by ``lang`` if both sides have it) the closest dictionary word.

    Two words within the distance share a delete neighbour of their prefixes, so the search is an equality
    join with an exact check.  Of equal distances the more frequent word wins, then the alphabet.  Result:
    ``word, suggestion, distance``; words without any candidate are missing.
    """
    keys = ["lang"] if "lang" in words.columns and "lang" in dictionary.columns else []
    asked = words.select(*keys, "word").filter(F.col("word").isNotNull()).distinct()
    known = dictionary.select(*keys, F.col("word").alias("term"), "count")
    left = asked.select(*keys, "word", F.explode(delete_neighbours(F.col("word"), distance)).alias("key"))
    right = known.select(*keys, "term", "count", F.explode(delete_neighbours(F.col("term"), distance)).alias("key"))
    pairs = left.join(right, [*keys, "key"]).filter(F.abs(F.length("word") - F.length("term")) <= distance)
    near = pairs.withColumn("distance", F.levenshtein("word", "term")).filter(F.col("distance") <= distance)
    # The smallest (distance, -count, term).
    return near.groupBy(*keys, "word").agg(
        F.min_by("term", F.struct("distance", -F.col("count"), F.col("term"))).alias("suggestion"),
        F.min("distance").alias("distance"),
    )


def eligible_tokens(blocks: DataFrame, keys: list[str], s: Settings = DEFAULT) -> DataFrame:
    """One row for each token with ``pos, token, eligible, run``; runs are maximal spans of eligible tokens."""
    rows = blocks.select(*keys, "language", "confidence", F.posexplode(X.tokens(F.col("text"))).alias("pos", "token"))
    low = F.coalesce("confidence", F.lit(0.0)) < s.spell_confidence
    flagged = rows.withColumn("eligible", X.checkable_token(F.col("token")) & low)
    return runs(flagged, keys, "pos", "eligible")


def hit_rate(tokens: DataFrame, dictionary: DataFrame, keys: list[str]) -> DataFrame:
    """Share of eligible tokens that the dictionary has; 1 without eligible tokens."""
    # Frequent words are hot keys, so the dictionary goes to the tokens as long as it is small.
    words = broadcast_if_small(dictionary.select(F.col("word").alias("token"), F.lit(1).alias("known")).distinct())
    joined = tokens.join(words, "token", "left")
    n = F.sum(F.when(F.col("eligible"), 1).otherwise(0))
    known = F.sum(F.when(F.col("eligible") & F.col("known").isNotNull(), 1).otherwise(0))
    return joined.groupBy(*keys).agg(
        n.cast("int").alias("checkable"), F.when(n > 0, known / n).otherwise(1.0).alias("hit_rate")
    )


def correct_words(blocks: DataFrame, dictionary: DataFrame, keys: list[str], s: Settings = DEFAULT) -> DataFrame:
    """Word-by-word correction: ``corrected_text, corrections, hit_rate`` for each block.

    The tokens are joined by single spaces again only where at least one was eligible; else the text keeps
    its white space.
    """
    tokens = eligible_tokens(blocks, keys, s)
    fixes = kept(suggestions(tokens.filter("eligible").select(F.col("token").alias("word")), dictionary), "suggestions")
    fixes = fixes.select(F.col("word").alias("token"), "suggestion", "distance")
    joined = tokens.join(broadcast_if_small(fixes.filter("suggestion <> token")), "token", "left")
    changed = F.col("eligible") & F.col("suggestion").isNotNull() & (F.col("suggestion") != F.col("token"))
    item = F.struct("pos", F.when(changed, F.col("suggestion")).otherwise(F.col("token")).alias("t"))
    log = F.struct("pos", F.col("token").alias("original"), F.col("suggestion").alias("corrected"), "distance")
    done = joined.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.t), " ").alias("rejoined"),
        F.array_sort(F.collect_list(F.when(changed, log))).alias("corrections"),
        F.max("eligible").alias("any_eligible"),
    )
    rates = hit_rate(tokens, dictionary, keys)
    out = blocks.join(done, keys, "left").join(rates, keys, "left")
    text = F.when(F.coalesce("any_eligible", F.lit(False)), F.col("rejoined")).otherwise(F.col("text"))
    return out.withColumn("corrected_text", text).withColumn("hit_rate", F.coalesce("hit_rate", F.lit(1.0))).drop(
        "rejoined", "any_eligible"
    )


def word_list(dictionary: DataFrame) -> list[tuple[str, int]]:
    """The entries of a frequency dictionary, of which there may be MOST_WORDS."""
    rows = dictionary.groupBy("word").agg(F.sum("count").alias("count")).limit(MOST_WORDS + 1).collect()
    return [(r["word"], r["count"]) for r in rows]


class Compound:
    """Compound lookup: replaces words, splits one into two and joins two into one where that is likelier.

    A declared substitute for the reference's library: the choice minimises edit distance, then maximises
    frequency, on a dictionary that one worker holds in memory.
    """

    def __init__(self, words: Iterable[tuple[str, int]], distance: int = DISTANCE):
        self.count = dict(words)
        self.total = max(1, sum(self.count.values()))
        self.distance = distance
        self.index: dict[str, list[str]] = {}
        for w in self.count:
            for key in self._deletes(w):
                self.index.setdefault(key, []).append(w)

    def _deletes(self, word: str) -> set[str]:
        found = level = {word[:PREFIX]}
        for _ in range(self.distance):
            level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
            found = found | level
        return found

    def lookup(self, word: str) -> tuple[int, float, str]:
        """(distance, -log probability, word) of the best entry; the word itself if none is near."""
        if word in self.count:
            return 0, -math.log(self.count[word] / self.total), word
        best = (self.distance + 1, 60.0, word)
        for term in {t for key in self._deletes(word) for t in self.index.get(key, ())}:
            if abs(len(term) - len(word)) <= self.distance:
                d = X.word_distance(word, term)
                if d <= self.distance:
                    best = min(best, (d, -math.log(self.count[term] / self.total), term))
        return best

    def _split(self, word: str) -> tuple[int, float, str]:
        best = (self.distance + 1, 60.0, word)
        for i in range(1, len(word)):
            a, b = word[:i], word[i:]
            if a in self.count and b in self.count:
                cost = -math.log(self.count[a] / self.total) - math.log(self.count[b] / self.total)
                best = min(best, (1, cost, f"{a} {b}"))
        return best

    def correct(self, words: list[str]) -> list[str]:
        """The corrected words of a run."""
        out: list[str] = []
        at = 0
        while at < len(words):
            one = self.lookup(words[at])
            if at + 1 < len(words):
                joined = self.lookup(words[at] + words[at + 1])
                apart = one[0] + self.lookup(words[at + 1])[0]
                if joined[0] + 1 < apart:
                    out.append(joined[2])
                    at += 2
                    continue
            best = min(one, self._split(words[at])) if one[0] else one
            out += best[2].split()
            at += 1
        return out


def correct_runs(blocks: DataFrame, dictionary: list[tuple[str, int]], keys: list[str], s: Settings = DEFAULT) -> DataFrame:
    """Compound correction of each run of eligible tokens: ``corrected_text, corrections`` for each block.

    ``dictionary`` is a frequency list of one language and bounded as such lists are; it is sent to every
    worker once.
    """
    spark = blocks.sparkSession
    dictionary = list(dictionary)
    if len(dictionary) > MOST_WORDS:
        raise ValueError(f"a dictionary of more than {MOST_WORDS} words does not belong into every worker")
    shared = spark.sparkContext.broadcast(dictionary)
    state: dict[str, Compound] = {}

    @F.pandas_udf("struct<text:string,log:array<struct<original:string,corrected:string,distance:int>>>")
    def fix(run: pd.Series) -> pd.DataFrame:
        if "c" not in state:
            state["c"] = Compound(shared.value)
        checker = state["c"]
        rows = []
        for words in run:
            after = checker.correct(list(words))
            log = [{"original": a, "corrected": b, "distance": d} for a, b, d in X.opcodes(list(words), after)]
            rows.append((" ".join(after), log))
        return pd.DataFrame(rows, columns=["text", "log"])

    tokens = eligible_tokens(blocks, keys, s)
    item = F.struct("pos", "token")
    spans = tokens.filter("eligible").groupBy(*keys, "run").agg(
        F.min("pos").alias("pos"), F.transform(F.array_sort(F.collect_list(item)), lambda x: x.token).alias("words")
    )
    fixed = spans.withColumn("f", fix("words")).select(*keys, "pos", F.col("f.text").alias("piece"), F.col("f.log").alias("log"))
    rest = tokens.filter(~F.col("eligible")).select(
        *keys, "pos", F.col("token").alias("piece"), F.lit(None).cast("array<struct<original:string,corrected:string,distance:int>>").alias("log")
    )
    piece = F.struct("pos", "piece")
    done = fixed.unionByName(rest).groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x.piece), " ").alias("rejoined"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("log").isNotNull(), F.struct("pos", "log")))), lambda x: x.log)).alias("corrections"),
        F.max(F.col("log").isNotNull()).alias("any_eligible"),
    )
    out = blocks.join(done, keys, "left")
    text = F.when(F.coalesce("any_eligible", F.lit(False)), F.col("rejoined")).otherwise(F.col("text"))
    return out.withColumn("corrected_text", text).drop("rejoined", "any_eligible")


def devanagari_votes(blocks: DataFrame, dictionaries: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Hit rate of each block in each candidate dictionary, and the best language (the first on ties)."""
    every = kept(eligible_tokens(blocks, keys, Settings(spell_confidence=1.0)), "tokens")
    out = blocks.select(*keys)
    for lang, words in dictionaries.items():
        out = out.join(hit_rate(every, words, keys).select(*keys, F.col("hit_rate").alias(lang)), keys, "left")
    filled = out.na.fill(1.0, list(dictionaries))
    best = F.greatest(*(F.col(c) for c in dictionaries)) if len(dictionaries) > 1 else F.col(next(iter(dictionaries)))
    chain = F.coalesce(*(F.when(F.col(c) == best, F.lit(c)) for c in dictionaries))
    return filled.withColumn("language", chain)

