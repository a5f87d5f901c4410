"""Orders: reading order over columns, page order, runs, and the best of several attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from .blocks import PAGE


def column_of(blocks: Column, s: Settings = DEFAULT) -> Column:
    """Columns of a page as an array of ``(x0, x1, items)`` by a fold over its blocks from left to right.

    ``blocks`` is an array of structs with ``x0, seq, y0, x1``.  A block joins the first column that it shares at
    least half of the narrower width with, and the column's range grows; else it opens a new column.
    """
    empty = F.filter(
        F.array(F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("x1"), blocks.alias("items"))), lambda c: F.lit(False)
    )

    def step(columns: Column, b: Column) -> Column:
        def joins(c: Column) -> Column:
            shared = F.least(b.x1, c.x1) - F.greatest(b.x0, c.x0)
            narrow = F.least(b.x1 - b.x0, c.x1 - c.x0)
            return (narrow > 0) & (shared / narrow >= s.column_overlap)

        found = F.array_position(F.transform(columns, joins), True)
        grown = F.transform(
            columns,
            lambda c, i: F.when(
                i == found - 1,
                F.struct(
                    F.least(c.x0, b.x0).alias("x0"),
                    F.greatest(c.x1, b.x1).alias("x1"),
                    F.concat(c["items"], F.array(b)).alias("items"),
                ),
            ).otherwise(c),
        )
        opened = F.concat(columns, F.array(F.struct(b.x0.alias("x0"), b.x1.alias("x1"), F.array(b).alias("items"))))
        return F.when(found > 0, grown).otherwise(opened)

    return F.aggregate(F.array_sort(blocks, _across), empty, step)


def reading_order(blocks: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """``blocks`` with ``column_number`` and ``reading_order`` (both from 1) and the page's ``block_id``.

    Columns go from left to right (by the order in which they were opened on ties), blocks inside a column
    from top to bottom (by x0 and seq on ties).  A page is folded natively; its blocks are one array, as a
    page is bounded by what fits on paper.
    """
    rest = [F.col(c) for c in blocks.columns if c not in (*PAGE, "column_number", "reading_order", "block_id")]
    item = F.struct(
        F.col("bbox.x0").alias("x0"), F.col("seq").cast("int").alias("seq"), F.col("bbox.y0").alias("y0"), F.col("bbox.x1").alias("x1"),
        F.struct(*rest).alias("block"),
    )
    # The blocks travel through the fold of their page, so they need no join to get their places.
    pages = blocks.groupBy(*PAGE).agg(F.collect_list(item).alias("items"))
    by_left = F.array_sort(F.transform(column_of(F.col("items"), s), lambda c, i: F.struct(c.x0.alias("left"), i.alias("opened"), c["items"].alias("items"))), _left)
    down = F.transform(
        by_left, lambda c, k: F.transform(F.array_sort(F.transform(c["items"], lambda b, at: F.struct(b.y0.alias("y0"), at.alias("at"), b.block.alias("block"))), _down), lambda b: F.struct((k + 1).alias("column_number"), b.block.alias("block")))
    )
    rows = pages.select(*PAGE, F.posexplode(F.flatten(down)).alias("_at", "_b"))
    placed = rows.select(*PAGE, "_b.block.*", "_b.column_number", (F.col("_at") + 1).alias("reading_order"))
    return placed.withColumn("block_id", block_id(F.col("page_number"), F.col("reading_order")))


def _before(*pairs: tuple[Column, Column]) -> Column:
    """-1, 0 or 1 for the first pair that differs; compares what sorts and leaves out what does not."""
    out = F.lit(0)
    for x, y in reversed(pairs):
        out = F.when(x < y, -1).when(x > y, 1).otherwise(out)
    return out


def _across(a: Column, b: Column) -> Column:
    return _before((a.x0, b.x0), (a.seq, b.seq))


def _left(a: Column, b: Column) -> Column:
    return _before((a.left, b.left), (a.opened, b.opened))


def _down(a: Column, b: Column) -> Column:
    return _before((a.y0, b.y0), (a["at"], b["at"]))


def block_id(page: Column, place: Column) -> Column:
    return F.concat(F.lit("p"), page.cast("string"), F.lit("_b"), place.cast("string"))


def page_order(blocks: DataFrame) -> DataFrame:
    """The order of a page read: by (y0, x0), renumbered; differs from the reading order on several columns."""
    w = Window.partitionBy(*PAGE).orderBy(F.col("bbox.y0"), F.col("bbox.x0"), "seq")
    placed = blocks.withColumn("place", F.row_number().over(w))
    return placed.withColumn("block_id", block_id(F.col("page_number"), F.col("place")))


def runs(rows: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """Maximal runs of consecutive rows with ``flag``: ``run`` (from 0), null for the others."""
    w = Window.partitionBy(*keys).orderBy(order)
    starts = F.col(flag) & ~F.coalesce(F.lag(flag).over(w), F.lit(False))
    numbered = rows.withColumn("_start", F.when(starts, 1).otherwise(0))
    run = F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return numbered.withColumn("run", F.when(F.col(flag), run)).drop("_start")


def best_attempt(attempts: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Of ordered attempts (``attempt``, ``confidence``) the best before trying stops.

    Attempt 0 always counts.  Trying stops after the first later attempt at which the best so far reaches the
    threshold; the earliest of equals wins.
    """
    w = Window.partitionBy(*keys).orderBy("attempt")
    # The best before this attempt; attempt 1 is tried whatever attempt 0 gave.
    before = F.max("confidence").over(w.rowsBetween(Window.unboundedPreceding, -1))
    tried = attempts.withColumn("_before", before).filter((F.col("attempt") <= 1) | (F.col("_before") < threshold))
    return tried.groupBy(*keys).agg(
        F.max_by("attempt", F.struct(F.col("confidence"), -F.col("attempt"))).alias("attempt"),
        F.max("confidence").alias("confidence"),
        F.count(F.lit(1)).alias("tried"),
    )
