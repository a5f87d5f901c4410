"""Tables: HTML to cells, and cells to a grid of texts."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import TABLE


class _Cells(HTMLParser):
    """Rows of (text, row span, column span, is th) of the first table."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[list]] = []
        self.depth, self.done = 0, False
        self.cell: list | None = None

    @staticmethod
    def _span(value: str | None) -> int:
        try:
            return int(value)
        except (TypeError, ValueError):
            return 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.done:
            return
        if tag == "table":
            self.depth += 1
        elif self.depth and tag == "tr":
            self.cell = None
            self.rows.append([])
        elif self.depth and tag in ("td", "th") and self.rows:
            named = dict(attrs)
            self.cell = [[], self._span(named.get("rowspan", "1")), self._span(named.get("colspan", "1")), tag == "th"]
            self.rows[-1].append(self.cell)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr"):
            self.cell = None
        elif tag == "table" and self.depth:
            self.depth -= 1
            self.done = self.done or not self.depth

    def handle_data(self, data: str) -> None:
        if self.cell is not None and not self.done and data.strip():
            self.cell[0].append(data.strip())


def parse_table(html: str | None, scores: list[float] | None) -> dict:
    """The table struct of predicted HTML; scores belong to the cells in order, missing ones are 0."""
    reader = _Cells()
    reader.feed(html or "")
    reader.close()
    scores = [] if scores is None else list(scores)
    taken: set[tuple[int, int]] = set()
    cells, widest = [], 0
    for r, row in enumerate(reader.rows):
        at = 0
        for parts, down, across, is_th in row:
            while (r, at) in taken:
                at += 1
            score = float(scores[len(cells)]) if len(cells) < len(scores) else 0.0
            cells.append(
                {
                    "row": r,
                    "col": at,
                    "row_span": down,
                    "col_span": across,
                    "text": "".join(parts),
                    "is_header": is_th or r == 0,
                    "confidence": round(score, 4),
                }
            )
            taken |= {(r + i, at + j) for i in range(down) for j in range(across)}
            at += across
            widest = max(widest, at)
    return {"rows": len(reader.rows), "cols": widest, "cells": cells}


@F.pandas_udf(TABLE)
def html_table(html: pd.Series, scores: pd.Series) -> pd.DataFrame:
    """Table struct of an HTML column; null and tableless HTML give 0 rows."""
    return pd.DataFrame([parse_table(h, c) for h, c in zip(html, scores)], columns=["rows", "cols", "cells"])


def table_confidence(table: Column) -> Column:
    """Mean confidence of the cells, 4 decimals, 0 without cells."""
    total = F.aggregate(table["cells"], F.lit(0.0), lambda a, c: a + c.confidence)
    return F.when(F.size(table["cells"]) > 0, F.round(total / F.size(table["cells"]), 4)).otherwise(0.0)


def grid(table: Column, clean=lambda text: text) -> Column:
    """Array of rows of cell texts: spans repeat a text and are cut at the edges; later cells win.

    ``clean`` is applied to each text.  Tables without rows or columns give an empty array.  Every cell is spread
    over its slots once; the last of each slot, in order of slots, are the grid.
    """
    rows, cols = table.rows, table.cols
    none = F.array().cast("array<int>")

    def span(start: Column, n: Column, end: Column) -> Column:
        first, last = F.greatest(start, F.lit(0)), F.least(start + F.greatest(n, F.lit(1)), end) - 1
        return F.when(start.isNotNull() & (first <= last), F.sequence(first, last)).otherwise(none)

    def slot(at: Column, order: Column, text: Column) -> Column:
        return F.struct(at.alias("at"), order.alias("order"), text.alias("text"))

    def spread(cell: Column, k: Column) -> Column:
        def line(r: Column) -> Column:
            text = clean(F.coalesce(cell.text, F.lit("")))
            return F.transform(span(cell.col, cell.col_span, cols), lambda c: slot(r * cols + c, k, text))

        return F.flatten(F.transform(span(cell.row, cell.row_span, rows), line))

    blank = F.transform(F.sequence(F.lit(0), rows * cols - 1), lambda i: slot(i, F.lit(-1), clean(F.lit(""))))
    every = F.array_sort(F.concat(blank, F.flatten(F.transform(F.coalesce(table["cells"], F.slice(table["cells"], 1, 0)), spread))))
    # Bound to names of lambdas, so that each is computed once.
    last = F.transform(F.array(every), lambda e: F.filter(e, lambda x, i: ~F.coalesce(F.get(e, i + 1)["at"] == x["at"], F.lit(False))))
    lines = F.transform(
        last, lambda d: F.transform(F.sequence(F.lit(0), rows - 1), lambda r: F.transform(F.slice(d, r * cols + 1, cols), lambda x: x.text))
    )[0]
    filled = (F.coalesce(rows, F.lit(0)) > 0) & (F.coalesce(cols, F.lit(0)) > 0)
    # Only filled tables come to the sequences; a negative end would count downwards.
    return F.when(filled, lines).otherwise(F.array().cast("array<array<string>>"))


def markdown_table(table: Column) -> Column:
    """GFM table with the first row as header; an empty string for an empty table."""

    def clean(text: Column) -> Column:
        return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))

    lines = F.transform(grid(table, clean), lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |")))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), table.cols), " | "), F.lit(" |"))
    body = F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(0))))
    return F.when(F.size(lines) > 0, F.array_join(body, "\n")).otherwise("")


def text_table(table: Column) -> Column:
    """Tab-separated rows; an empty string for an empty table."""

    def clean(text: Column) -> Column:
        return F.translate(text, "\t\n", "  ")

    return F.array_join(F.transform(grid(table, clean), lambda r: F.array_join(r, "\t")), "\n")
