"""A page from recognition to reviewed blocks, with an error block for every page that fails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..operators.blocks import PAGE, error_block, union_blocks
from ..operators.routing import Recogniser, blocks_of, errors_of, recognised, run_pages
from ..scratch import kept
from .lineblocks import postprocess


def extract_pages(
    pages: DataFrame,
    primary: Recogniser,
    variants: list[tuple[str, Recogniser]],
    fallback: Recogniser,
    structure: Recogniser | None = None,
    s: Settings = DEFAULT,
) -> tuple[DataFrame, DataFrame]:
    """(blocks, pages with ``ocr_attempt``) of all ``pages`` (``page_width, page_height``, maybe ``error``).

    Pages with an ``error`` and pages on which the primary recogniser reports one get the error block and the
    attempt ``error``.  All others go through the router; ``structure`` adds tables and figures, and what it
    fails on only lacks them.
    """
    columns = [*PAGE, "page_width", "page_height"]
    pages = kept((pages if "error" in pages.columns else pages.withColumn("error", F.lit(None).cast("string"))).select(*columns, "error"), "pages")
    good = pages.filter(F.col("error").isNull()).select(*columns)
    found = recognised(primary, good, "primary")
    if found is None:
        failed = good.select(*PAGE, F.lit("recogniser failed").alias("error"))
    else:
        failed = errors_of(found)
    failed = kept(failed.unionByName(pages.filter(F.col("error").isNotNull()).select(*PAGE, "error")), "failed-pages")
    wrong = error_block(failed)
    if found is None:
        return wrong, failed.select(*PAGE, F.lit("error").alias("ocr_attempt"))
    read = good.join(failed, PAGE, "left_anti")
    sized = blocks_of(found).drop("page_width", "page_height").join(read, PAGE)
    texts, attempts = run_pages(sized, variants, fallback, s, read)
    extra = None if structure is None else recognised(structure, read.select(*PAGE), "structure")
    parts = [texts] if extra is None else [texts, blocks_of(extra)]
    done = postprocess(union_blocks(*parts), s)
    marked = attempts.unionByName(failed.select(*PAGE, F.lit("error").alias("ocr_attempt")))
    return done.unionByName(wrong, allowMissingColumns=True), marked
