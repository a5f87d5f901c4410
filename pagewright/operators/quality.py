"""Page and document quality, confidence aggregates and review tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, TEXT_TYPES, Settings
from ..functions import geometry as G
from ..functions import text as X
from .blocks import PAGE


def review_status(confidence: Column, s: Settings = DEFAULT) -> Column:
    """accepted, flagged or needs_review by confidence."""
    return (
        F.when(confidence >= s.accept_confidence, "accepted")
        .when(confidence >= s.flag_confidence, "flagged")
        .otherwise("needs_review")
    )


def review_routing(blocks: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Sets ``review_status`` and ``needs_review``.  A figure keeps its own rule on top; null counts as true."""
    status = review_status(F.coalesce("confidence", F.lit(0.0)), s)
    low = F.col("review_status") == "needs_review"
    own = F.coalesce(F.col("needs_review"), F.lit(True)) if "needs_review" in blocks.columns else F.lit(True)
    needs = F.when(F.col("type") == "figure", own | low).otherwise(low)
    return blocks.withColumn("review_status", status).withColumn("needs_review", needs)


def corrected_needs_no_review(blocks: DataFrame) -> DataFrame:
    """An applied correction ends the need for review; the status stays."""
    needs = F.col("needs_review") & ~F.coalesce(F.col("correction_applied"), F.lit(False))
    return blocks.withColumn("needs_review", needs)


def rounded(x: Column, places: int) -> Column:
    """Rounded half away from zero on the double ``x * 10 ** places``, as SQL engines round doubles.

    Spark's own goes by the digits that a double is printed with, which gives other results near halves.
    """
    scale = float(10**places)
    return F.round(x * scale) / scale


def in_order(blocks: DataFrame, value: Column) -> Column:
    """Aggregate: the known values of a page in the order of ``seq``, or, if blocks have none, of their size."""
    if "seq" not in blocks.columns:
        return F.array_sort(F.collect_list(value))
    pairs = F.collect_list(F.when(value.isNotNull(), F.struct("seq", value.alias("value"))))
    return F.transform(F.array_sort(pairs), lambda e: e.value)


def total(values: Column) -> Column:
    """Sum of an array from its first value to its last; 0 if it is empty."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def page_sums(blocks: DataFrame, ranges: dict | None = None) -> list[Column]:
    """Aggregates of a page's blocks from which its confidence, quality and languages follow.

    They need one grouping by page; the languages of its texts and the confidences are arrays, as a page is bounded by
    what fits on paper.  Sums of confidences go by the order of the blocks, not by that in which rows arrive, as the
    last bit of a sum of doubles depends on it, and with it a rounded half.
    """
    is_text = F.col("type").isin(*TEXT_TYPES)
    filled = is_text & (F.coalesce(F.length("text"), F.lit(0)) > 0)
    corrected = F.coalesce(F.col("correction_applied"), F.lit(False)) if "correction_applied" in blocks.columns else F.lit(False)
    language = F.coalesce("language", F.lit("und"))
    named = F.when(~F.col("type").isin("table", "figure"), F.coalesce("language", F.lit("en")))
    confidence = F.col("confidence").cast("double")
    known = in_order(blocks, confidence)
    return [
        F.count(F.lit(1)).alias("n_blocks"),
        known.alias("confidences"),
        total(known).alias("c_all"),
        F.sum(F.when(is_text, 1).otherwise(0)).alias("n_text"),
        total(in_order(blocks, F.when(is_text, confidence))).alias("c_sum"),
        F.sum(F.when(filled, 1).otherwise(0)).alias("n_filled"),
        F.sum(F.when(filled & ~corrected, 1).otherwise(0)).alias("n_unchanged"),
        F.sum(F.when(filled, F.length("text")).otherwise(0)).alias("chars"),
        F.sum(F.when(filled, X.expected_characters(F.col("text"), language, ranges)).otherwise(0)).alias("expected"),
        F.sum(G.area(F.col("bbox"))).alias("covered"),
        F.collect_list(F.when(is_text, language)).alias("text_languages"),
        F.array_sort(F.collect_set(named)).alias("languages"),
    ]


def with_scores(sums: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """The five components and the weighted score, from :func:`page_sums` and ``page_area``.

    Null sums stand for a page without blocks.  Components without any text block are 1, the coverage of an
    empty page is 0, so such a page scores 0.85 by the default weights.
    """

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(1.0)

    said = F.col("text_languages")
    dominant = F.array_max(F.transform(F.array_distinct(said), lambda x: F.size(F.filter(said, lambda y: y == x))))
    covered = F.least(F.coalesce(F.col("covered"), F.lit(0.0)) / F.col("page_area"), F.lit(1.0))
    parts = {
        "confidence": share("c_sum", "n_text"),
        "text_quality": share("n_unchanged", "n_filled"),
        "character_quality": share("expected", "chars"),
        "coverage": F.when(F.col("page_area") > 0, covered).otherwise(0.0),
        "language_consistency": F.when(F.col("n_text") > 0, dominant / F.col("n_text")).otherwise(1.0),
    }
    weights = (s.weight_confidence, s.weight_text, s.weight_characters, s.weight_coverage, s.weight_language)
    score = sum((w * F.col(name) for w, name in zip(weights, parts)), F.lit(0.0))
    return sums.withColumns(parts).withColumn("quality_score", F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))))


COMPONENTS = ("confidence", "text_quality", "character_quality", "coverage", "language_consistency")


def page_quality(
    blocks: DataFrame, keys: list[str] | None = None, s: Settings = DEFAULT, ranges: dict | None = None, pages: DataFrame | None = None
) -> DataFrame:
    """The five components and the weighted score of every page, in one aggregation.

    ``blocks`` has ``type, text, bbox, confidence, language`` and may have ``correction_applied``.  The size of a
    page, ``page_width, page_height``, is a column of ``pages``, or else of the blocks.  Only ``pages`` can tell of
    pages without blocks.
    """
    keys = PAGE if keys is None else keys
    area = F.col("page_width") * F.col("page_height")
    if pages is None:
        sums = blocks.groupBy(*keys).agg(*page_sums(blocks, ranges), (F.max("page_width") * F.max("page_height")).alias("page_area"))
    else:
        sums = blocks.groupBy(*keys).agg(*page_sums(blocks, ranges))
        sums = pages.select(*keys, area.alias("page_area")).join(sums, keys, "left")
    return with_scores(sums, s).select(*keys, *COMPONENTS, "quality_score")


def document_quality(pages: DataFrame, key: str = "document_id") -> DataFrame:
    """Mean of the unrounded page scores."""
    return pages.groupBy(key).agg(F.avg("quality_score").alias("quality_score"), F.count(F.lit(1)).alias("pages"))


def page_confidence(blocks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean confidence over all blocks of a page."""
    return blocks.groupBy(*(PAGE if keys is None else keys)).agg(F.avg(F.coalesce("confidence", F.lit(0.0))).alias("avg_confidence"))


def document_confidence(blocks: DataFrame, key: str = "document_id") -> DataFrame:
    """Mean confidence over all blocks of a document, not over its pages; 4 decimals."""
    return blocks.groupBy(key).agg(rounded(F.coalesce(F.avg("confidence"), F.lit(0.0)), 4).alias("avg_confidence"))


def low_confidence_pages(pages: DataFrame, blocks: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """``document_id, low_confidence_pages``: sorted pages whose mean is low; a page without blocks is one."""
    means = pages.select(*PAGE).distinct().join(page_confidence(blocks), PAGE, "left")
    low = F.coalesce("avg_confidence", F.lit(0.0)) < s.low_page_confidence
    return means.groupBy("document_id").agg(
        F.array_sort(F.collect_list(F.when(low, F.col("page_number")))).alias("low_confidence_pages")
    )


def page_languages(blocks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sorted distinct languages of the text blocks of a page."""
    own = F.when(~F.col("type").isin("table", "figure"), F.coalesce("language", F.lit("en")))
    return blocks.groupBy(*(PAGE if keys is None else keys)).agg(F.array_sort(F.collect_set(own)).alias("languages"))
