"""Routing of pages between recognisers: mixed scripts, reasons, and the chain of decisions."""

from __future__ import annotations

import functools
import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import text as X
from ..scratch import kept
from .blocks import PAGE
from .quality import page_confidence, page_sums, with_scores
from .spatial import merge_engines

#: From pages to their blocks.
Recogniser = Callable[[DataFrame], DataFrame]


def script_sums(s: Settings = DEFAULT) -> list[Column]:
    """Aggregates of a page's texts: letters, and letters of each script family."""
    text = F.coalesce("text", F.lit(""))
    latin = X.SCRIPTS[0][0]
    letters = X.letters(text)
    # Texts in Latin letters alone, the usual case, are not searched for the other scripts.
    rest = F.when(text.rlike(f"[^\\x{{00}}-\\x{{{X.SCRIPTS[0][2]:X}}}]"), text)
    counts = [F.sum(F.coalesce(X.script_letters(rest, n), F.lit(0))).alias(n) for n, *_ in X.SCRIPTS[1:]]
    own = F.when(rest.isNull(), letters).otherwise(X.script_letters(text, latin))
    return [F.sum(letters).alias("letters"), F.sum(own).alias(latin), *counts]


def with_mix(page: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """``families`` with a fair share of the letters, and whether they are a mix that the primary recogniser does not read."""
    present = [F.when(F.col(n) / F.col("letters") >= s.script_share, F.lit(n)) for n, *_ in X.SCRIPTS]
    families = F.when(F.col("letters") > 0, F.array_compact(F.array(*present))).otherwise(F.array().cast("array<string>"))
    other = F.size(F.array_except("families", F.array(*(F.lit(p) for p in X.PRIMARY_SCRIPTS)))) > 0
    return page.withColumn("families", families).withColumn("mixed_script", (F.size("families") >= 2) & other)


def script_mix(blocks: DataFrame, keys: list[str] | None = None, s: Settings = DEFAULT) -> DataFrame:
    """Letters by script family, families with a fair share, and whether the page is a mix that the primary
    recogniser does not read."""
    return with_mix(blocks.groupBy(*(PAGE if keys is None else keys)).agg(*script_sums(s)), s)


def trigger_reasons(s: Settings = DEFAULT) -> Column:
    """Why a page goes to the fallback, in order; from ``avg_confidence, quality_score, has_table, mixed_script``."""
    return F.array_compact(
        F.array(
            F.when(
                F.col("avg_confidence") < s.primary_confidence,
                F.format_string("low_confidence(%.3f<%s)", F.col("avg_confidence"), F.lit(str(s.primary_confidence))),
            ),
            F.when(
                F.col("quality_score") < s.quality_threshold,
                F.format_string("low_quality_score(%.3f<%s)", F.col("quality_score"), F.lit(str(s.quality_threshold))),
            ),
            F.when(F.col("has_table"), F.lit("table_detected")),
            F.when(F.col("mixed_script"), F.lit("mixed_script")),
        )
    )


def route(pages: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """``route`` and ``reasons`` of pages that have the four signals.

    accept: the primary result stands.  retry: only confidence or quality is wanting, so image variants are
    worth a try.  fallback: the second engine is needed.
    """
    weak = (F.col("avg_confidence") < s.primary_confidence) | (F.col("quality_score") < s.quality_threshold)
    fixable = ~F.col("has_table") & ~F.col("mixed_script")
    choice = F.when(~weak & fixable, "accept").when(weak & fixable & F.lit(s.retry_variants), "retry").otherwise("fallback")
    return pages.withColumn("reasons", trigger_reasons(s)).withColumn("route", choice)


def page_signals(blocks: DataFrame, s: Settings = DEFAULT, ranges: dict | None = None, pages: DataFrame | None = None) -> DataFrame:
    """The signals that routing needs, from uncleaned primary blocks, in one aggregation.

    Tables are found later, so none is known.  ``pages`` (``page_width, page_height``) adds pages without blocks:
    their confidence is 0.
    """
    sums = [*page_sums(blocks, ranges), *script_sums(s)]
    if pages is None:
        page = blocks.groupBy(*PAGE).agg(*sums, (F.max("page_width") * F.max("page_height")).alias("page_area"))
    else:
        area = (F.col("page_width") * F.col("page_height")).alias("page_area")
        page = pages.select(*PAGE, area).join(blocks.groupBy(*PAGE).agg(*sums), PAGE, "left")
    scored = with_mix(with_scores(page, s), s)
    return scored.select(
        *PAGE,
        F.coalesce(F.col("c_all") / F.col("n_blocks"), F.lit(0.0)).alias("avg_confidence"),
        "quality_score",
        "families",
        "mixed_script",
        F.lit(False).alias("has_table"),
    )


def recognised(recognise: Recogniser, pages: DataFrame, name: str) -> DataFrame | None:
    """What a recogniser returns, written down so that it runs once; None if it fails as a whole."""
    try:
        return kept(recognise(pages), name)
    except Exception:  # a recogniser that fails must not lose what others have found
        logging.getLogger(__name__).warning("recogniser %s failed", name, exc_info=True)
        return None


def blocks_of(found: DataFrame) -> DataFrame:
    """The blocks a recogniser found."""
    return found.filter(F.col("error").isNull()).drop("error") if "error" in found.columns else found


def errors_of(found: DataFrame) -> DataFrame:
    """``document_id, page_number, error`` of the pages that a recogniser says it failed on."""
    if "error" not in found.columns:
        return found.limit(0).select(*PAGE, F.lit(None).cast("string").alias("error"))
    return found.filter(F.col("error").isNotNull()).groupBy(*PAGE).agg(F.min("error").alias("error"))


def run_pages(
    primary: DataFrame,
    variants: list[tuple[str, Recogniser]],
    fallback: Recogniser,
    s: Settings = DEFAULT,
    pages: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The whole chain on block tables: (blocks with ``engine_used`` and ``ocr_attempt``, pages with ``ocr_attempt``).

    ``pages`` (``page_width, page_height``) names all pages, those without primary blocks too; by default they
    are those of the blocks.  ``variants`` and ``fallback`` are the seams to recognisers: each gets the pages that
    need it (and no others) and returns their blocks.  A row with a non-null ``error`` says that its page failed.
    A variant that fails, on a page or as a whole, is skipped.  Where the fallback fails, the primary blocks stand
    with their attempt; where it finds nothing, they stand too, but the attempt is the fallback.
    """
    if pages is None:
        pages = primary.groupBy(*PAGE).agg(F.max("page_width").alias("page_width"), F.max("page_height").alias("page_height"))
    pages = kept(pages.select(*PAGE, "page_width", "page_height"), "pages")
    signals = kept(route(page_signals(primary, s, pages=pages), s), "signals")
    best = signals.filter(F.col("route") == "retry").select(*PAGE, F.lit(0).alias("attempt"), F.col("avg_confidence").alias("best"))
    tries: list[DataFrame] = []
    for number, (name, recognise) in enumerate(variants[: s.variant_attempts] if s.retry_variants else [], 1):
        open_ = best if number == 1 else best.filter(F.col("best") < s.primary_confidence)
        found = recognised(recognise, open_.select(*PAGE), name)
        tries.append(primary.limit(0) if found is None else blocks_of(found))
        means = page_confidence(tries[-1]).join(open_.select(*PAGE), PAGE, "left_semi").withColumnRenamed("avg_confidence", "now")
        better = F.coalesce(F.col("now") > F.col("best"), F.lit(False))
        best = best.join(means, PAGE, "left").select(
            *PAGE,
            F.when(better, number).otherwise(F.col("attempt")).alias("attempt"),
            F.when(better, F.col("now")).otherwise(F.col("best")).alias("best"),
        )
        best = kept(best, "best-attempts")
    won = best.filter("attempt > 0").select(*PAGE, "attempt")
    names = F.array(F.lit("original"), *(F.lit(name) for name, _ in variants[: len(tries)]))
    taken = primary.join(won, PAGE, "left_anti")
    if tries:
        again = [t.withColumn("attempt", F.lit(k)).join(won, [*PAGE, "attempt"], "left_semi").drop("attempt") for k, t in enumerate(tries, 1)]
        second = kept(functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), again), "variant-blocks")
        taken = taken.unionByName(second, allowMissingColumns=True)
        newer = route(page_signals(second, s, pages=pages.join(won, PAGE, "left_semi")), s)
        signals = signals.join(won, PAGE, "left_anti").unionByName(newer)
    # Every page with its attempt and whether it stands; one row for each page.
    state = signals.join(won, PAGE, "left").select(
        *PAGE,
        F.element_at(names, F.coalesce("attempt", F.lit(0)) + 1).alias("ocr_attempt"),
        (F.col("route") == "accept").alias("accepted"),
    )
    state = kept(state, "routes")
    rest = state.filter(~F.col("accepted"))
    found = recognised(fallback, rest.select(*PAGE), "fallback")
    failed = rest.select(*PAGE) if found is None else errors_of(found).select(*PAGE)
    state = state.join(failed.withColumn("_failed", F.lit(True)), PAGE, "left").select(
        *PAGE,
        F.when(~F.col("accepted") & F.col("_failed").isNull(), "fallback").otherwise(F.col("ocr_attempt")).alias("ocr_attempt"),
        (F.col("accepted") | F.coalesce("_failed", F.lit(False))).alias("stands"),
    )
    state = kept(state, "attempts")
    labelled = taken.drop("ocr_attempt").join(state, PAGE)
    done = labelled.filter("stands").drop("stands").withColumn("engine_used", F.lit("primary"))
    if found is not None:
        merged = merge_engines(labelled.filter("NOT stands"), blocks_of(found).join(state.filter("NOT stands").select(*PAGE), PAGE, "left_semi"), s)
        done = done.unionByName(merged.withColumn("ocr_attempt", F.lit("fallback")), allowMissingColumns=True)
    return done, state.select(*PAGE, "ocr_attempt")


def process_pages(
    primary: DataFrame,
    variants: list[tuple[str, Recogniser]],
    fallback: Recogniser,
    s: Settings = DEFAULT,
    pages: DataFrame | None = None,
) -> DataFrame:
    """The blocks of :func:`run_pages`."""
    return run_pages(primary, variants, fallback, s, pages)[0]
