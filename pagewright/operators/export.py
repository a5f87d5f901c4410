"""Exports of blocks in reading order: Markdown, plain text, and the draw lists of the three PDF forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import grid, markdown_table, text_table

# Page banner, fonts, colours.
BANNER = "=" * 20
FONTS = {"hi": "notosans-deva", "mr": "notosans-deva", "gu": "notosans-gujr"}
DEFAULT_FONT = "notosans-latn"
COLORS = {"en": (0.25, 0.55, 0.95), "hi": (0.95, 0.55, 0.15), "mr": (0.25, 0.75, 0.45), "gu": (0.85, 0.25, 0.55)}
DEFAULT_COLOR = (0.6, 0.6, 0.6)
FALLBACK_SIZE = (1654, 2339)


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def markdown_block(type_: Column, text: Column, table: Column | None, caption: Column, url: Column) -> Column:
    """The lines of one block, with the line break that ends them."""
    body = _blank(text)
    own = F.when(_blank(caption) == "", F.lit("\n")).otherwise(F.concat(F.lit("\n*"), caption, F.lit("*\n")))
    title = F.when(_blank(caption) == "", "figure").otherwise(caption)
    figure = F.concat(F.lit("\n!["), title, F.lit("]("), _blank(url), F.lit(")"), own)
    cells = F.lit("") if table is None else _blank(markdown_table(table))
    return (
        F.when(type_ == "heading", F.concat(F.lit("# "), body, F.lit("\n")))
        .when(type_ == "list", F.concat(F.lit("- "), body, F.lit("\n")))
        .when(type_ == "table", F.concat(F.lit("\n"), cells, F.lit("\n")))
        .when(type_ == "figure", figure)
        .otherwise(F.concat(body, F.lit("\n")))
    )


def text_block(type_: Column, text: Column, table: Column | None, caption: Column) -> Column:
    """The lines of one block in plain text, null where it has none."""
    cells = F.lit("") if table is None else _blank(text_table(table))
    return (
        F.when(type_ == "table", F.concat(cells, F.lit("\n")))
        .when(type_ == "figure", F.when(_blank(caption) != "", F.concat(F.lit("[Figure: "), caption, F.lit("]\n"))))
        .otherwise(F.when(_blank(text) != "", text))
    )


def _columns(blocks: DataFrame) -> dict[str, Column]:
    have = set(blocks.columns)
    text = {n: F.col(n) if n in have else F.lit(None).cast("string") for n in ("text", "caption", "image_url")}
    return text | {"table": F.col("table") if "table" in have else None}


def _document(blocks: DataFrame, piece: Column, page_text, pages: DataFrame | None) -> DataFrame:
    """Pieces joined by page and then by document; both are bounded by one document."""
    entry = F.struct("reading_order", piece.alias("piece"))
    by_page = blocks.groupBy("document_id", "page_number").agg(
        F.filter(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e.piece), lambda p: p.isNotNull()).alias("pieces")
    )
    if pages is not None:
        by_page = pages.select("document_id", "page_number").distinct().join(by_page, ["document_id", "page_number"], "left")
    pieces = F.coalesce("pieces", F.array().cast("array<string>"))
    whole = F.struct("page_number", page_text(F.col("page_number").cast("string"), pieces).alias("body"))
    return by_page.groupBy("document_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(whole)), lambda p: p.body), "\n").alias("body")
    )


def markdown(blocks: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """``document_id, body``: the Markdown of every document.  ``pages`` adds pages without blocks."""
    c = _columns(blocks)

    def page(number: Column, pieces: Column) -> Column:
        head = F.concat(F.lit("<!-- Page "), number, F.lit(" -->\n"))
        return F.array_join(F.concat(F.array(head), pieces, F.array(F.lit("\n"))), "\n")

    piece = markdown_block(F.col("type"), c["text"], c["table"], c["caption"], c["image_url"])
    return _document(blocks, piece, page, pages)


def plain_text(blocks: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """``document_id, body``: the plain text of every document."""
    c = _columns(blocks)

    def page(number: Column, pieces: Column) -> Column:
        head = F.concat(F.lit(f"{BANNER} Page "), number, F.lit(f" {BANNER}"))
        return F.array_join(F.concat(F.array(head, F.lit("")), pieces, F.array(F.lit(""))), "\n")

    return _document(blocks, text_block(F.col("type"), c["text"], c["table"], c["caption"]), page, pages)


def font_size(text: Column, width: Column, height: Column) -> Column:
    """Size at which an invisible text spans about its box."""
    n = F.greatest(F.length(text), F.lit(1))
    size = F.greatest(F.lit(4.0), F.least(width / n / 0.5, height * 0.9, F.lit(72.0)))
    return F.when(_blank(text) == "", 10.0).otherwise(size)


def font(language: Column) -> Column:
    """Font alias of a language."""
    table = F.create_map(*(F.lit(x) for kv in FONTS.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.coalesce(language, F.lit(""))), F.lit(DEFAULT_FONT))


def color(language: Column) -> Column:
    """RGB array of a language."""
    table = F.create_map(*(x for k, v in COLORS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.coalesce(F.try_element_at(table, F.coalesce(language, F.lit(""))), F.array(*map(F.lit, DEFAULT_COLOR)))


def _extent(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("w", F.greatest(F.col("bbox.x1") - F.col("bbox.x0"), F.lit(1.0))).withColumn(
        "h", F.greatest(F.col("bbox.y1") - F.col("bbox.y0"), F.lit(1.0))
    )


def searchable_draws(blocks: DataFrame) -> DataFrame:
    """Invisible texts of the searchable PDF: position, size and font of every block with text."""
    rows = _extent(blocks.filter(_blank(F.col("text")) != "" ))
    return rows.select(
        "document_id",
        "page_number",
        "reading_order",
        "text",
        F.col("bbox.x0").alias("x"),
        (F.col("bbox.y0") + F.col("h") * 0.85).alias("y"),
        font_size(F.col("text"), F.col("w"), F.col("h")).alias("size"),
        font(F.col("language")).alias("font"),
    )


def highlight_draws(blocks: DataFrame) -> DataFrame:
    """Coloured rectangles behind the texts."""
    rows = blocks.filter(_blank(F.col("text")) != "")
    return rows.select(
        "document_id", "page_number", "reading_order", "bbox", color(F.col("language")).alias("fill"), F.lit(0.30).alias("opacity")
    )


def legend(blocks: DataFrame) -> DataFrame:
    """Languages in the legend of each page: those of this page and of all pages before it, sorted."""
    shown = blocks.select("document_id", "page_number", F.when(_blank(F.col("text")) != "", F.coalesce("language", F.lit("en"))).alias("language"))
    first = shown.filter(F.col("language").isNotNull()).groupBy("document_id", "language").agg(F.min("page_number").alias("since"))
    # A document has few languages, so what travels with each page is short.
    known = first.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("language", "since"))).alias("known"))
    pages = shown.select("document_id", "page_number").distinct().join(known, "document_id", "left")
    upto = F.filter("known", lambda k: k.since <= F.col("page_number"))
    languages = F.coalesce(F.transform(upto, lambda k: k.language), F.array().cast("array<string>"))
    return pages.select("document_id", "page_number", languages.alias("languages"))


def structured_draws(blocks: DataFrame) -> DataFrame:
    """Visible texts, table cells and figures of the rebuilt page; ``kind`` text, cell or figure."""
    rows = _extent(blocks)
    texts = rows.filter(~F.col("type").isin("table", "figure") & (_blank(F.col("text")) != "")).select(
        "document_id",
        "page_number",
        "reading_order",
        F.lit("text").alias("kind"),
        "text",
        F.col("bbox.x0").alias("x"),
        F.col("bbox.y0").alias("y"),
        F.least(F.lit(11.0), F.greatest(F.lit(6.0), F.col("h") * 0.7)).alias("size"),
    )
    figures = rows.filter((F.col("type") == "figure") & F.col("image_url").isNotNull()).select(
        "document_id",
        "page_number",
        "reading_order",
        F.lit("figure").alias("kind"),
        F.col("image_url").alias("text"),
        F.col("bbox.x0").alias("x"),
        F.col("bbox.y0").alias("y"),
        F.lit(None).cast("double").alias("size"),
    )
    if "table" not in blocks.columns:
        return texts.unionByName(figures)
    lines = rows.filter(F.col("type") == "table").withColumn("grid", grid(F.col("table"))).select(
        "*", F.size("grid").alias("n"), F.posexplode("grid").alias("r", "line")
    )
    cells = lines.select("*", F.size("line").alias("m"), F.posexplode("line").alias("c", "cell")).filter("cell <> ''")
    high, wide = F.col("h") / F.col("n"), F.col("w") / F.col("m")
    drawn = cells.select(
        "document_id",
        "page_number",
        "reading_order",
        F.lit("cell").alias("kind"),
        F.col("cell").alias("text"),
        (F.col("bbox.x0") + F.col("c") * wide + 2).alias("x"),
        (F.col("bbox.y0") + F.col("r") * high + high * 0.7).alias("y"),
        F.least(F.lit(9.0), high * 0.6).alias("size"),
    )
    return texts.unionByName(figures).unionByName(drawn)


def page_size(pages: DataFrame) -> DataFrame:
    """Size of the rebuilt pages: that of the image, or the fallback."""
    return pages.withColumn("width", F.coalesce("page_width", F.lit(FALLBACK_SIZE[0]))).withColumn(
        "height", F.coalesce("page_height", F.lit(FALLBACK_SIZE[1]))
    )


def figure_url(bucket: str, job: Column, block: Column) -> Column:
    """Where a figure's crop is stored."""
    return F.concat(F.lit(f"s3://{bucket}/results/"), job, F.lit("/"), block, F.lit(".png"))
