"""URL filters: longest matching rule, else logistic regression on hashed character n-grams.

Everything that touches the table of URLs is a DataFrame expression.  The model is fitted on a small
labelled table whose features come from the same expression, so training and scoring hash alike.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host and path); a rule holds for its host and all subdomains and for paths that start so.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Bounds of what may be written into a plan or fitted on the driver.
MOST_RULES, MOST_LABELLED, BUCKETS, GRAM = 2_000, 20_000, 8192, 3

#: The small labelled table: a label (1: block) and a URL in each line.
LABELLED = Path(__file__).with_name("urls.tsv")


@lru_cache(maxsize=1)
def labelled_urls() -> tuple[tuple[str, int], ...]:
    """The small labelled table as (url, label), 1 for URLs to block; written by hand, each host once."""
    lines = LABELLED.read_text(encoding="utf-8").splitlines()
    return tuple((url, int(label)) for label, url in (line.split("\t") for line in lines))


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null where none does.

    Of rules of equal length that fit, the last in alphabetical order wins.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules do not belong into one expression")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, slash, below = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + below))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def with_buckets(parts: DataFrame, *keep: str) -> DataFrame:
    """Columns ``keep`` and ``buckets``: numbers of the character n-grams of ``host`` and ``path``.

    The n-grams are marked by where they came from.  Letters, n-grams and buckets are made in projections
    of their own: inside one expression they would be computed anew for every n-gram.
    """

    def letters(column: str) -> Column:
        return F.filter(F.split(F.concat(F.lit("^"), F.col(column), F.lit("$")), ""), lambda c: c != "")

    def grams(column: str) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(column) - (GRAM - 1), F.lit(1)))
        return F.transform(at, lambda i: F.concat(F.lit(column), F.array_join(F.slice(column, i, GRAM), "")))

    split = parts.select(*keep, letters("host").alias("_h"), letters("path").alias("_p"))
    return split.select(
        *keep,
        F.transform(
            F.concat(grams("_h"), grams("_p")), lambda g: F.pmod(F.xxhash64(g), F.lit(BUCKETS)).cast("int")
        ).alias("buckets"),
    )


def fit(
    spark: SparkSession, labelled: Sequence[tuple[str, int]] | None = None, rounds: int = 800, decay: float = 1e-4
) -> np.ndarray:
    """Weights of the buckets, the last one the intercept; full-batch gradient steps, so always the same.

    A feature is a bucket's share of the URL's n-grams (scaled by the root of their number).  A labelled
    table without both classes gives zero weights: every score is then 0.5 and nothing is blocked.
    """
    labelled = labelled_urls() if labelled is None else list(labelled)
    if len(labelled) > MOST_LABELLED:
        raise ValueError(f"the labelled table is bounded to {MOST_LABELLED} rows")
    if len({y for _, y in labelled}) < 2:
        return np.zeros(BUCKETS + 1)
    table = spark.createDataFrame(list(labelled), "url string, label int")
    rows = with_buckets(
        table.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "label"), "label"
    ).collect()
    x = np.zeros((len(rows), BUCKETS + 1))
    for i, r in enumerate(rows):
        np.add.at(x[i], r["buckets"], 1 / np.sqrt(len(r["buckets"])))
    x[:, -1] = 1
    y = np.array([r["label"] for r in rows], float)
    w = np.zeros(BUCKETS + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        step = x.T @ (p - y) / len(y)
        step[:-1] += decay * w[:-1]
        w -= 2.0 * step
    return w


def score_of(buckets: Column, weights: np.ndarray) -> Column:
    """Probability that the URL with these buckets is to be blocked."""
    # One string that the optimizer folds into one array; a literal for each weight would bloat the plan.
    table = F.split(F.lit(",".join(repr(float(w)) for w in weights[:-1])), ",").cast("array<double>")
    total = F.aggregate(buckets, F.lit(0.0), lambda a, b: a + F.get(table, b))
    return 1 / (1 + F.exp(-(F.lit(float(weights[-1])) + total / F.sqrt(F.size(buckets)))))


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: Sequence[tuple[str, int]] | None = None
) -> DataFrame:
    """``page_id, host, path, rule, verdict, block_score`` of every URL.

    The verdict is the longest fitting rule's, else ``block`` where the model's score is above one half.
    A null URL or one without ``://`` has an empty host and path, fits no rule and is judged by the
    model.  An empty table gives no rows; repeated rows are kept; other columns are ignored.
    """
    prepare(pages.sparkSession)
    weights = fit(pages.sparkSession, labelled)
    url = F.col("url")
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    scored = with_buckets(parts, "page_id", "host", "path").select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        verdict.alias("by_rule"),
        score_of(F.col("buckets"), weights).alias("block_score"),
    )
    by_model = F.when(F.col("block_score") > 0.5, "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", by_model).alias("verdict"), "block_score"
    )
