"""Rectangles as structs ``x0, y0, x1, y1``: areas, overlaps, gaps and windows as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bbox(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The struct of four edges."""
    edges = zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1))
    return F.struct(*(c.cast("double").alias(n) for n, c in edges))


def area(b: Column) -> Column:
    """Area; 0 where an extent is negative."""
    return F.greatest(b.x1 - b.x0, F.lit(0.0)) * F.greatest(b.y1 - b.y0, F.lit(0.0))


def overlap_area(a: Column, b: Column) -> Column:
    """Area of the intersection, 0 if there is none."""
    wide = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)
    high = F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def containment(inner: Column, outer: Column) -> Column:
    """Share of ``inner`` that lies inside ``outer``; 0 for a degenerate ``inner``."""
    own = area(inner)
    return F.when(own > 0, overlap_area(inner, outer) / own).otherwise(0.0)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    both = overlap_area(a, b)
    either = area(a) + area(b) - both
    return F.when(either > 0, both / either).otherwise(0.0)


def vertical_gap(a: Column, b: Column) -> Column:
    """Distance between the rectangles from above to below; 0 where they overlap vertically."""
    return F.greatest(b.y0 - a.y1, a.y0 - b.y1, F.lit(0.0))


def touches_horizontally(a: Column, b: Column) -> Column:
    """Whether the horizontal ranges meet, ends included."""
    return (b.x1 >= a.x0) & (b.x0 <= a.x1)


def center(b: Column) -> Column:
    """Midpoint as a struct ``x, y``."""
    return F.struct(((b.x0 + b.x1) / 2).alias("x"), ((b.y0 + b.y1) / 2).alias("y"))


def polygon_bbox(points: Column) -> Column:
    """Smallest rectangle around an array of points ``x, y``."""
    xs, ys = F.transform(points, lambda p: p.x), F.transform(points, lambda p: p.y)
    return bbox(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def crop_window(b: Column, width: Column, height: Column, padding: int = 0) -> Column:
    """Whole-pixel window inside the page, padded; null where nothing is left."""
    x0 = F.greatest(b.x0.cast("int") - padding, F.lit(0))
    y0 = F.greatest(b.y0.cast("int") - padding, F.lit(0))
    x1 = F.least(b.x1.cast("int") + padding, width.cast("int"))
    y1 = F.least(b.y1.cast("int") + padding, height.cast("int"))
    window = F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    return F.when((x1 > x0) & (y1 > y0), window)


def raster_zoom(width_pt: Column, height_pt: Column, dpi: int = 200, longest_edge: int = 2200) -> Column:
    """Zoom that renders a page at ``dpi`` unless its longest edge would exceed the cap."""
    return F.least(F.lit(dpi / 72.0), F.lit(float(longest_edge)) / F.greatest(width_pt, height_pt))


def upright_angle(angle: Column) -> Column:
    """A rectangle's angle folded into -45..45 degrees; below half a degree it counts as 0."""
    folded = F.when(angle < -45, angle + 90).when(angle > 45, angle - 90).otherwise(angle)
    return F.when(F.abs(folded) < 0.5, 0.0).otherwise(folded)
