"""Provider-backed correction with safety rails: reasons, cache, response parsing, quota and retries."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, STRUCTURE_TYPES, Settings
from ..functions import text as X

RESPONSE = "struct<corrections:array<struct<block_id:string,corrected_text:string>>>"


def cache_key(text: Column, language: Column) -> Column:
    """SHA-256 of language, a zero byte and text."""
    return F.sha2(F.concat(language, F.lit("\x00"), text), 256)


def parse_response(response: Column) -> Column:
    """Map of block id to corrected text from a provider's answer, null if it has no valid object.

    The object may stand among other text.  Entries that are no pairs of strings are skipped and the last of
    equal ids wins.
    """
    body = F.regexp_extract(response, r"(?s)\{.*\}", 0)
    raw = F.from_json(body, "struct<corrections:array<string>>")
    shape = "struct<block_id:string,corrected_text:string>"
    pairs = F.filter(
        F.transform(raw.corrections, lambda e: F.from_json(e, shape)),
        lambda e: e.block_id.isNotNull() & e.corrected_text.isNotNull(),
    )
    # Keep the last of equal ids without depending on the session's policy for duplicate map keys.
    last = F.filter(
        F.transform(pairs, lambda e, i: F.struct(e.block_id.alias("k"), e.corrected_text.alias("v"), i.alias("i"))),
        lambda e: F.size(F.filter(F.slice(pairs, e.i + 2, F.size(pairs)), lambda o: o.block_id == e.k)) == 0,
    )
    found = F.map_from_arrays(F.transform(last, lambda e: e.k), F.transform(last, lambda e: e.v))
    return F.when(raw.corrections.isNotNull(), found)


def retry_delay(payload: Column) -> Column:
    """Seconds that the server asks to wait, from an error payload; null if it does not say."""
    details = F.coalesce(F.get_json_object(payload, "$.error.details"), F.get_json_object(payload, "$.details"))
    items = F.from_json(details, "array<struct<`@type`:string,retryDelay:string>>")
    wanted = F.filter(items, lambda d: d["@type"].endswith("RetryInfo") & d.retryDelay.rlike("^[0-9.]+s$"))
    return F.try_element_at(F.transform(wanted, lambda d: F.regexp_extract(d.retryDelay, "^([0-9.]+)s$", 1).cast("double")), F.lit(1))


def daily_quota(payload: Column) -> Column:
    """Whether an error payload names a quota for the day."""
    details = F.coalesce(F.get_json_object(payload, "$.error.details"), F.get_json_object(payload, "$.details"))
    items = F.from_json(details, "array<struct<`@type`:string,violations:array<struct<quotaId:string>>>>")
    return F.coalesce(
        F.exists(
            items,
            lambda d: d["@type"].endswith("QuotaFailure")
            & F.exists(d.violations, lambda v: F.coalesce(v.quotaId.contains("PerDay"), F.lit(False))),
        ),
        F.lit(False),
    )


def server_backoff(attempt: Column, s: Settings = DEFAULT) -> Column:
    """Wait before the next attempt after a server error, doubled each time up to a cap."""
    return F.least(F.lit(s.initial_delay) * F.pow(F.lit(2.0), attempt - 1), F.lit(s.max_delay))


def precheck(blocks: DataFrame, cache: DataFrame | None = None, s: Settings = DEFAULT) -> DataFrame:
    """``key, reason, corrected_text`` as far as they are known without a provider; ``reason`` null: ask it."""
    text = F.coalesce("text", F.lit(""))
    language = F.when(F.coalesce("language", F.lit("")) == "", "en").otherwise(F.col("language"))
    skip = F.col("type").isin(*STRUCTURE_TYPES) | (X.strip(text) == "")
    sure = F.coalesce("confidence", F.lit(0.0)) >= s.skip_confidence
    keyed = blocks.withColumn("original_text", text).withColumn("key", cache_key(text, language))
    if cache is None:
        keyed = keyed.withColumn("cached", F.lit(None).cast("string"))
    else:
        keyed = keyed.join(cache.select("key", F.col("corrected_text").alias("cached")).dropDuplicates(["key"]), "key", "left")
    reason = (
        F.when(F.coalesce(skip, F.lit(False)), "skipped_type")
        .when(sure, "skipped_high_confidence")
        .when(F.col("cached").isNotNull(), "cache_hit")
    )
    return keyed.withColumn("reason", reason)


def distinct_requests(checked: DataFrame) -> DataFrame:
    """One request for each distinct (language, text): what equal blocks share is asked once."""
    return checked.filter(F.col("reason").isNull()).select("key", "original_text", "language").dropDuplicates(["key"])


def apply_answers(checked: DataFrame, answers: DataFrame | None, s: Settings = DEFAULT) -> DataFrame:
    """Reasons and texts after the provider.

    ``answers`` has ``key, answer, failed``; None means that no provider is set.  A missing answer is an
    invalid response, an unchanged one ok, one too far from the text is rejected.
    """
    if answers is None:
        joined = checked.withColumn("answer", F.lit(None).cast("string")).withColumn("failed", F.lit(None).cast("boolean"))
        unanswered = F.lit("provider_disabled")
    else:
        joined = checked.join(answers.select("key", "answer", "failed").dropDuplicates(["key"]), "key", "left")
        unanswered = F.lit("invalid_response")
    far = X.edit_ratio(F.col("original_text"), F.col("answer")) > s.max_edit_ratio
    reason = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.coalesce("failed", F.lit(False)), "api_error")
        .when(F.col("answer").isNull(), unanswered)
        .when(far, "edit_distance_rejected")
        .otherwise("ok")
    )
    corrected = (
        F.when(F.col("correction_reason") == "cache_hit", F.col("cached"))
        .when(F.col("correction_reason") == "ok", F.col("answer"))
        .otherwise(F.col("original_text"))
    )
    return (
        joined.withColumn("correction_reason", reason)
        .withColumn("corrected_text", corrected)
        .withColumn("correction_applied", F.col("corrected_text") != F.col("original_text"))
        .drop("answer", "failed", "cached", "reason")
    )


def new_cache_rows(corrected: DataFrame) -> DataFrame:
    """What goes into the cache table: answers that were used, unchanged ones too."""
    return corrected.filter(F.col("correction_reason") == "ok").select("key", "corrected_text").dropDuplicates(["key"])


class Retryable(Exception):
    """A provider's error: ``status`` of the response, ``delay`` asked for, and whether a day's quota is used up."""

    def __init__(self, status: int, delay: float | None = None, daily: bool = False):
        super().__init__(f"status {status}")
        self.status, self.delay, self.daily = status, delay, daily


class CallPolicy:
    """Spacing, waiting, backing off and breaking the circuit around a provider's calls in one process."""

    def __init__(self, s: Settings = DEFAULT, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.s, self.clock, self.sleep = s, clock, sleep
        self.last: float | None = None
        self.open_until: float | None = None

    def cooling(self) -> float:
        return 0.0 if self.open_until is None else max(0.0, self.open_until - self.clock())

    def _space(self) -> None:
        if self.last is not None:
            rest = 60.0 / max(self.s.requests_per_minute, 1) - (self.clock() - self.last)
            if rest > 0:
                self.sleep(rest)
        self.last = self.clock()

    def call(self, request: Callable[[], object]) -> object:
        """The request's result; raises the last :class:`Retryable` when the policy gives up."""
        waits = failures = 0
        if self.cooling() > 0:
            raise Retryable(429, daily=True)
        while True:
            self._space()
            try:
                return request()
            except Retryable as e:
                if e.status == 429 and e.daily:
                    self.open_until = self.clock() + 60 * self.s.cooldown_minutes
                    raise
                if e.status == 429 and waits < self.s.rate_limit_waits:
                    delay = e.delay or self.s.max_delay
                    if delay > self.s.honored_delay:
                        raise
                    waits += 1
                    self.sleep(delay)
                elif e.status >= 500:
                    failures += 1
                    if failures >= self.s.server_attempts:
                        raise
                    self.sleep(min(self.s.initial_delay * 2 ** (failures - 1), self.s.max_delay))
                else:
                    raise


_POLICIES: dict[Settings, CallPolicy] = {}


def process_policy(s: Settings) -> CallPolicy:
    """The one policy of this process for these settings: all its tasks share spacing and circuit breaker."""
    return _POLICIES.setdefault(s, CallPolicy(s))


Provider = Callable[[list[dict]], dict[str, str]]
#: Providers by name.  Network providers register here; this package ships none and the offline one below.
PROVIDERS: dict[str, Callable[..., Provider]] = {}


def dictionary_provider(replacements: dict[str, str]) -> Provider:
    """A deterministic provider that replaces words; for tests and offline runs."""

    def correct(items: list[dict]) -> dict[str, str]:
        return {i["block_id"]: " ".join(replacements.get(w, w) for w in i["text"].split(" ")) for i in items}

    return correct


PROVIDERS["dictionary"] = dictionary_provider


def ask(requests: DataFrame, provider: Provider, batch: int = 32, s: Settings = DEFAULT) -> DataFrame:
    """``key, answer, failed`` from a provider that is called with batches of ``block_id, text, language``."""

    def run(frames):
        policy = process_policy(s)
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                items = [
                    {"block_id": k, "text": t, "language": lang}
                    for k, t, lang in zip(part["key"], part["original_text"], part["language"])
                ]
                try:
                    found, failed = policy.call(lambda items=items: provider(items)), False
                except Exception:  # the chain must go on with raw text whatever a provider does
                    found, failed = {}, True
                yield pd.DataFrame({"key": part["key"], "answer": [found.get(i["block_id"]) for i in items], "failed": failed})

    return requests.mapInPandas(run, "key string, answer string, failed boolean")


def correct_blocks(blocks: DataFrame, provider: Provider | None = None, cache: DataFrame | None = None, s: Settings = DEFAULT) -> DataFrame:
    """The whole stage: checks, one request for each distinct text, answers, reasons."""
    checked = precheck(blocks, cache, s)
    answers = None if provider is None else ask(distinct_requests(checked), provider, s=s)
    return apply_answers(checked, answers, s)


def legacy_correction(blocks: DataFrame, dictionaries: dict[str, DataFrame], keys: list[str], s: Settings = DEFAULT) -> DataFrame:
    """The older, offline branch: every text block is spell-checked with its language's dictionary.

    Languages that split and join badly are corrected word by word, the others by runs.  Blocks of languages
    without a dictionary keep their text; the reason is the same for all.
    """
    from . import spell

    have = F.col("language").isin(*dictionaries)
    out = blocks.filter(~F.coalesce(have, F.lit(False))).withColumn("corrected_text", F.col("text"))
    for lang, words in dictionaries.items():
        own = blocks.filter(F.col("language") == lang)
        if lang in spell.WORD_BY_WORD:
            done = spell.correct_words(own, words, keys, s)
        else:
            done = spell.correct_runs(own, spell.word_list(words), keys, s)
        out = out.unionByName(done.select(*blocks.columns, "corrected_text"))
    return (
        out.withColumn("original_text", F.col("text"))
        .withColumn("correction_applied", F.col("corrected_text") != F.col("text"))
        .withColumn("correction_reason", F.lit("legacy"))
    )
