"""The nested output tree of a document, from flat blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from .blocks import PAGE
from .quality import page_sums, rounded, total, with_scores

#: What a block may carry in the tree, in the order of the output.
FIELDS = (
    "block_id", "type", "text", "original_text", "corrected_text", "correction_applied", "correction_reason", "bbox",
    "confidence", "language", "engine_used", "table", "subtype", "image_url", "caption", "alt_text", "review_status",
    "needs_review",
)
TYPES = {
    "correction_applied": "boolean", "needs_review": "boolean", "confidence": "double",
    "table": "struct<rows:int,cols:int,cells:array<struct<row:int,col:int,row_span:int,col_span:int,text:string,"
    "is_header:boolean,confidence:double>>>",
}
TEXT_ONLY = ("text", "original_text", "corrected_text", "correction_applied", "correction_reason", "language", "engine_used")
FIGURE_ONLY = ("subtype", "image_url", "caption", "alt_text")


def projected(blocks: DataFrame) -> dict[str, Column]:
    """The fields of a block in the tree by name: null where its type does not have them; the text is the corrected one."""
    have = set(blocks.columns)

    def field(name: str) -> Column:
        c = F.col(name) if name in have else F.lit(None).cast(TYPES.get(name, "string"))
        if name == "text" and "corrected_text" in have:
            c = F.coalesce("corrected_text", c)
        if name == "bbox":
            c = F.array(*(F.col(f"bbox.{e}") for e in ("x0", "y0", "x1", "y1")))
        if name in TEXT_ONLY:
            return F.when(~F.col("type").isin("table", "figure"), c)
        if name == "table":
            return F.when(F.col("type") == "table", c)
        return F.when(F.col("type") == "figure", c) if name in FIGURE_ONLY else c

    return {name: field(name) for name in FIELDS}


def project_by_type(blocks: DataFrame) -> DataFrame:
    """Every field null that the block's type does not have."""
    return blocks.select(*PAGE, "reading_order", *(c.alias(name) for name, c in projected(blocks).items()))


def pages_tree(blocks: DataFrame, pages: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """One row for each page with its blocks nested in reading order, languages, attempt, quality and confidence.

    ``pages`` has ``page_width, page_height, ocr_attempt``; pages without blocks get an empty list, confidence 0
    and the score of an empty page.  Everything about a page comes from one aggregation of its blocks.
    """
    columns = {f"_{f}": c for f, c in projected(blocks).items()}
    text = F.coalesce("corrected_text", "text") if "corrected_text" in blocks.columns else F.col("text")
    # Dealt out by document once, which serves the page, the match with ``pages`` and the tree.
    rows = blocks.repartition("document_id").withColumns(columns).withColumn("text", text)
    entry = F.struct("reading_order", F.struct(*(F.col(f"_{f}").alias(f) for f in FIELDS)).alias("block"))
    nested = rows.groupBy(*PAGE).agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e.block).alias("blocks"), *page_sums(rows)
    )
    area = (F.col("page_width") * F.col("page_height")).alias("page_area")
    known = pages.select(*PAGE, area, F.coalesce("ocr_attempt", F.lit("original")).alias("ocr_attempt"))
    scored = with_scores(_matched(known, nested), s)
    low = F.coalesce(F.col("c_all") / F.col("n_blocks"), F.lit(0.0)) < s.low_page_confidence
    return scored.select(*PAGE, "ocr_attempt", "blocks", "languages", "quality_score", "confidences", low.alias("low"))


def _matched(pages: DataFrame, sums: DataFrame) -> DataFrame:
    """``pages`` with what ``sums`` has of them, both by page, null where it has none.

    They meet by document and are taken apart again, as the tree is put together by document: so the blocks are not
    dealt out by page in between.  A document's blocks are one row of the tree anyway.
    """
    own, parts = ([c for c in t.columns if c != "document_id"] for t in (pages, sums))
    listed = pages.groupBy("document_id").agg(F.collect_list(F.struct(*own)).alias("_pages"))
    items = F.collect_list(F.struct(*parts))
    found = sums.groupBy("document_id").agg(items.alias("_found"), F.transform(items, lambda f: f.page_number).alias("_numbers"))

    def pair(page: Column) -> Column:
        at = (F.array_position("_numbers", page.page_number) - 1).cast("int")
        return F.struct(page.alias("page"), F.get("_found", at).alias("sums"))

    pairs = listed.join(found, "document_id", "left").select("document_id", F.explode(F.transform("_pages", pair)).alias("_pair"))
    rest = [F.col(f"_pair.sums.{c}").alias(c) for c in parts if c != "page_number"]
    return pairs.select("document_id", *(F.col(f"_pair.page.{c}").alias(c) for c in own), *rest)


def document_tree(documents: DataFrame, pages: DataFrame, blocks: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """One row for each document with the whole tree as columns ready for :func:`to_json`."""
    page = F.struct(
        "page_number",
        F.coalesce("languages", F.array().cast("array<string>")).alias("language_detected"),
        "ocr_attempt",
        rounded(F.col("quality_score"), 4).alias("quality_score"),
        F.coalesce("blocks", F.array()).alias("blocks"),
    )
    none = F.array().cast("array<double>")
    # Page by page and block by block, so that the last bits of the means do not depend on the order of the rows.
    marks = F.array_sort(F.collect_list(F.struct("page_number", "quality_score", F.coalesce("confidences", none).alias("confidences"))))
    known = F.flatten(F.transform(marks, lambda p: p.confidences))
    nested = pages_tree(blocks, pages, s).groupBy("document_id").agg(
        F.array_sort(F.collect_list(page), lambda a, b: F.when(a.page_number < b.page_number, -1).otherwise(1)).alias("pages"),
        F.count(F.lit(1)).cast("int").alias("page_count"),
        (total(F.transform(marks, lambda p: p.quality_score)) / F.size(marks)).alias("avg_quality_score"),
        rounded(F.when(F.size(known) > 0, total(known) / F.size(known)).otherwise(0.0), 4).alias("avg_confidence"),
        F.array_sort(F.collect_list(F.when(F.col("low"), F.col("page_number")))).alias("low_confidence_pages"),
    )
    metadata = F.struct("avg_confidence", "low_confidence_pages").alias("metadata")
    found = documents.select("document_id", "filename").join(nested, "document_id")
    return found.select("document_id", "filename", "page_count", "pages", metadata, "avg_quality_score")


def to_json(tree: DataFrame, pretty: bool = False) -> DataFrame:
    """``document_id, json``: fields that a type does not have are left out."""
    body = F.struct("document_id", "filename", "page_count", "pages", "metadata")
    return tree.select("document_id", F.to_json(body, {"pretty": str(pretty).lower()}).alias("json"))
