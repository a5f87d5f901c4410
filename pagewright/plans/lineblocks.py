"""Blocks made from ``documents``: every line becomes a rectangle by fixed integer arithmetic.

Recogniser output is not part of the tables, so this view stands in for it wherever an operator on blocks is
checked against SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import geometry as G
from ..operators.blocks import PAGE, block_type
from ..operators.correction import correct_blocks
from ..operators.export import markdown
from ..operators.layout import reading_order
from ..operators.quality import review_routing
from ..operators.spatial import merge_duplicates, suppress_inside
from ..functions.text import clean_text
from ..scratch import kept

PAGE_WIDTH, PAGE_HEIGHT = 900, 2200

LINES_SQL = """
  SELECT doc_id, lang, line AS text, seq,
    50 + 400 * (seq % 2) AS x0, 20 * (seq // 2) AS y0,
    50 + 400 * (seq % 2) + least(350, 7 * length(line)) AS x1,
    20 * (seq // 2) + CASE WHEN length(line) <= 40 THEN 36 ELSE 16 END AS y1,
    CAST(500 + (31 * doc_id + 17 * seq) % 500 AS DOUBLE) / 1000 AS confidence
  FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq
        FROM documents WHERE text IS NOT NULL)
  WHERE trim(line) <> ''
"""


def line_blocks(documents: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """One block for each non-blank line: ``document_id, page_number, seq, text, bbox, confidence, language, type``."""
    lines = documents.select(
        F.col("doc_id").alias("document_id"), F.col("lang").alias("language"), F.posexplode(F.split("text", "\n")).alias("seq", "text")
    ).filter(F.trim("text") != "")
    n, seq = F.length("text"), F.col("seq")
    x0, y0 = 50 + 400 * (seq % 2), 20 * F.floor(seq / 2)
    box = G.bbox(x0, y0, x0 + F.least(F.lit(350), 7 * n), y0 + F.when(n <= 40, 36).otherwise(16))
    confidence = (500 + (31 * F.col("document_id") + 17 * seq) % 500) / 1000
    made = lines.select(
        "document_id", F.lit(1).alias("page_number"), "seq", "text", box.alias("bbox"), confidence.alias("confidence"), "language"
    )
    return made.withColumn("type", block_type(F.col("text"), F.col("bbox"), s))


def structures(blocks: DataFrame) -> DataFrame:
    """Every seventh line (from the fourth) as a figure, ten pixels taller."""
    taller = F.struct(*(F.col(f"bbox.{e}").alias(e) for e in ("x0", "y0", "x1")), (F.col("bbox.y1") + 10).alias("y1"))
    return blocks.filter(F.col("seq") % 7 == 3).withColumn("bbox", taller).withColumn("type", F.lit("figure"))


def with_structures(blocks: DataFrame) -> DataFrame:
    """The same lines as figures, all others as texts."""
    return blocks.filter(F.col("seq") % 7 != 3).unionByName(structures(blocks))


def postprocess(blocks: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Clean, suppress, merge duplicates, route to review: the whole chain of a page.

    The cleaned blocks are written down, as duplicates are searched for in them and then taken from them.
    """
    text = F.when(F.col("type").isin("table", "figure"), F.col("text")).otherwise(clean_text(F.col("text")))
    cleaned = kept(suppress_inside(blocks.withColumn("text", text), s), "clean-blocks")
    return review_routing(merge_duplicates(cleaned, s=s), s)


def removal_counts(blocks: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """``document_id, page_number, inside_structures, duplicates``: how many blocks the post-processing of a page removes."""
    left = kept(suppress_inside(blocks, s), "suppressed")
    merged = merge_duplicates(left, s=s)
    counts = [t.groupBy(*PAGE).agg(F.count(F.lit(1)).alias(n)) for t, n in ((blocks, "all"), (left, "left"), (merged, "merged"))]
    joined = counts[0].join(counts[1], PAGE, "left").join(counts[2], PAGE, "left").na.fill(0, ["left", "merged"])
    return joined.select(*PAGE, (F.col("all") - F.col("left")).alias("inside_structures"), (F.col("left") - F.col("merged")).alias("duplicates"))


def documents_to_markdown(blocks: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Post-processing, order, correction and export in one plan."""
    corrected = correct_blocks(reading_order(postprocess(blocks, s), s), s=s)
    return markdown(corrected.withColumn("text", F.col("corrected_text")))
