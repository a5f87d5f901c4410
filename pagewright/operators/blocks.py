"""From recogniser output to blocks: parsing, typing, figures, projection and union."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import DEFAULT, Settings
from ..functions import geometry as G
from ..functions import text as X

# Layout labels.
FIGURE_LABELS = ("image", "figure", "picture", "chart")
TABLE_LABELS = ("table",)
PAGE = ["document_id", "page_number"]


def block_type(text: Column, box: Column, s: Settings = DEFAULT) -> Column:
    """Heading for few words on a high line, else paragraph."""
    short = F.size(X.tokens(text)) <= s.heading_words
    return F.when(short & (box.y1 - box.y0 >= s.heading_height), "heading").otherwise("paragraph")


def parse_lines(raw: DataFrame, s: Settings = DEFAULT, errors: bool = False) -> DataFrame:
    """Recogniser arrays ``rec_texts, rec_scores, rec_polys`` to one row for each line.

    The arrays are cut to the shortest.  Blank texts and polygons without points are dropped; the rest keep
    their place as ``seq``.  Null arrays read as empty.  With ``errors``, a page on which the recogniser
    reports an ``error`` has one more row that has nothing but it.
    """
    names = ("rec_texts", "rec_scores", "rec_polys")
    n = F.least(*(F.coalesce(F.size(c), F.lit(0)) for c in names))
    zipped = F.arrays_zip(*(F.slice(F.col(c), F.lit(1), F.greatest(n, F.lit(0))).alias(c) for c in names))
    lines = raw.select(*PAGE, F.posexplode(zipped).alias("seq", "line")).select(
        *PAGE,
        "seq",
        X.strip(F.col("line.rec_texts")).alias("text"),
        F.coalesce(F.col("line.rec_scores"), F.lit(0.0)).alias("confidence"),
        F.col("line.rec_polys").alias("points"),
    )
    kept = lines.filter((F.col("text") != "") & (F.size("points") > 0))
    boxed = kept.withColumn("bbox", G.polygon_bbox(F.col("points"))).drop("points")
    typed = boxed.withColumn("type", block_type(F.col("text"), F.col("bbox"), s))
    if not errors:
        return typed
    failed = raw.filter(F.col("error").isNotNull()).select(*PAGE, "error")
    return typed.unionByName(failed, allowMissingColumns=True)


def parse_fallback_lines(raw: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Rows ``seq, text, confidence, bbox array`` of the second engine; no score counts as 0, no box drops the line."""
    edges = [F.get(F.col("bbox"), i) for i in range(4)]
    kept = raw.filter(F.col("bbox").isNotNull() & (F.size("bbox") == 4) & (X.strip(F.col("text")) != ""))
    boxed = kept.select(
        *PAGE,
        "seq",
        X.strip(F.col("text")).alias("text"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        G.bbox(*edges).alias("bbox"),
    )
    return boxed.withColumn("type", block_type(F.col("text"), F.col("bbox"), s))


def valid_layout(boxes: DataFrame) -> DataFrame:
    """Layout boxes with four coordinates."""
    return boxes.filter(F.size("coordinate") == 4)


def figure_regions(boxes: DataFrame) -> DataFrame:
    """Figure regions with their subtype."""
    edges = [F.get(F.col("coordinate"), i) for i in range(4)]
    return valid_layout(boxes).filter(F.col("label").isin(*FIGURE_LABELS)).select(
        *PAGE,
        "seq",
        F.when(F.col("label") == "chart", "chart").otherwise("image").alias("subtype"),
        F.col("score").alias("confidence"),
        G.bbox(*edges).alias("bbox"),
    )


def table_windows(boxes: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Padded, clamped crop windows of table regions; the table model runs on these alone."""
    edges = [F.get(F.col("coordinate"), i) for i in range(4)]
    out = valid_layout(boxes).filter(F.col("label").isin(*TABLE_LABELS)).withColumn("bbox", G.bbox(*edges))
    window = G.crop_window(F.col("bbox"), F.col("page_width"), F.col("page_height"), s.crop_padding)
    return out.withColumn("window", window).filter(F.col("window").isNotNull())


def analyze_structure(boxes: DataFrame, s: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(table regions with crop windows, figure regions with subtypes) of a page's layout boxes.

    The layout model ran once; tables and figures are two selections from its boxes.
    """
    return table_windows(boxes, s), figure_regions(boxes)


def figure_blocks(figures: DataFrame, texts: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Figure blocks with crop window, caption and their own review rule.  Degenerate regions are dropped."""
    from .spatial import with_captions

    window = G.crop_window(F.col("bbox"), F.col("page_width"), F.col("page_height"))
    cropped = figures.withColumn("window", window).filter(F.col("window").isNotNull())
    sure = (F.col("confidence") >= s.figure_confidence) & F.col("caption").isNotNull()
    return with_captions(cropped, texts, s).select(
        "*",
        F.lit("figure").alias("type"),
        F.lit("").alias("text"),
        F.lit("und").alias("language"),
        F.lit("layout").alias("engine_used"),
        F.lit(None).cast("string").alias("alt_text"),
        (~F.coalesce(sure, F.lit(False))).alias("needs_review"),
    )


def union_blocks(*parts: DataFrame) -> DataFrame:
    """Texts, tables and figures of a page in this order, with ``seq`` renumbered over all of them."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for p in tagged[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy(*PAGE).orderBy("_part", "seq"))
    return out.withColumn("seq", place - 1).drop("_part")


def error_block(pages: DataFrame) -> DataFrame:
    """The one block of a page that failed, with its ``error`` if the table has that column."""
    zero = F.lit(0.0)
    said = F.coalesce(F.col("error"), F.lit("")) if "error" in pages.columns else F.lit("")
    return pages.select(
        *PAGE,
        F.lit(0).alias("seq"),
        F.lit("paragraph").alias("type"),
        F.concat(F.lit("[OCR ERROR on page "), F.col("page_number").cast("string"), F.lit(": "), said, F.lit("]")).alias("text"),
        G.bbox(zero, zero, zero, zero).alias("bbox"),
        zero.alias("confidence"),
        F.lit("und").alias("language"),
        F.lit("error").alias("engine_used"),
        F.lit("error").alias("ocr_attempt"),
        F.lit("needs_review").alias("review_status"),
        F.lit(True).alias("needs_review"),
    )


def by_page(df: DataFrame, order: list[str], work: Callable[[list[dict]], list[tuple]], schema: T.StructType) -> DataFrame:
    """Apply ``work`` to the rows of each page, which come as dicts in the given order.

    The rows are dealt by page and sorted inside the partitions; a task streams through its pages and holds one
    of them at a time.  That costs far less for each page than a grouped call with frames of its own.
    """
    target = to_arrow_schema(schema)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(target)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, held, out = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                key = (row[PAGE[0]], row[PAGE[1]])
                if key != page and held:
                    out += work(held)
                    held = []
                    if len(out) >= 2000:
                        yield pack(out)
                        out = []
                page = key
                held.append(row)
        if held:
            out += work(held)
        if out:
            yield pack(out)

    return df.repartition(*PAGE).sortWithinPartitions(*PAGE, *order).mapInArrow(run, schema)
