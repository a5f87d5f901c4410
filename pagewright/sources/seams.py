"""Seams to models and image libraries: what the engine calls, and deterministic stand-ins.

Recognition, layout and rasterising need libraries and weights that are not part of this package.  Each
seam is a callable over DataFrames or an iterator of pandas frames, so a model is loaded once for each worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

#: A recogniser turns pages (``document_id, page_number, image``) into blocks.
Recogniser = Callable[[DataFrame], DataFrame]

OCR_SCHEMA = (
    "document_id string, page_number int, rec_texts array<string>, rec_scores array<double>, "
    "rec_polys array<array<struct<x:double,y:double>>>, error string"
)


def recognise(pages: DataFrame, load: Callable[[], Callable[[bytes], tuple[list, list, list]]]) -> DataFrame:
    """Recogniser arrays of page images.

    ``load()`` runs once for each worker task and returns a function from image bytes to texts, scores and
    polygons.  A page on which it fails has empty arrays and the message in ``error``.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in frames:
            out = []
            for image in pdf["image"]:
                try:
                    texts, scores, polygons = model(image)
                    error = None
                except Exception as e:  # a page that a model cannot read must not fail the job
                    texts, scores, polygons, error = [], [], [], str(e)[:1000] or type(e).__name__
                out.append((texts, scores, [[{"x": x, "y": y} for x, y in p] for p in polygons], error))
            yield pd.DataFrame(
                {
                    "document_id": pdf["document_id"],
                    "page_number": pdf["page_number"],
                    "rec_texts": [o[0] for o in out],
                    "rec_scores": [o[1] for o in out],
                    "rec_polys": [o[2] for o in out],
                    "error": [o[3] for o in out],
                }
            )

    return pages.select("document_id", "page_number", "image").mapInPandas(run, OCR_SCHEMA)


def no_tables(pages: DataFrame) -> DataFrame:
    """The primary engine finds no tables; they come from layout regions later."""
    return pages.withColumn("has_table", F.lit(False))


def fake_reader(image: bytes) -> tuple[list[str], list[float], list[list[tuple[float, float]]]]:
    """Stand-in: every line of the bytes is a text line of fixed height."""
    lines = image.decode("utf-8", "replace").split("\n")
    boxes = [[(0, 20 * i), (7 * len(t), 20 * i), (7 * len(t), 20 * i + 16), (0, 20 * i + 16)] for i, t in enumerate(lines)]
    return lines, [0.9] * len(lines), boxes


def raster_plan(pages: DataFrame, dpi: int = 200, longest_edge: int = 2200) -> DataFrame:
    """Zoom and pixel size of every page from its size in points."""
    zoom = G.raster_zoom(F.col("width_pt"), F.col("height_pt"), dpi, longest_edge)
    return (
        pages.withColumn("zoom", zoom)
        .withColumn("page_width", F.round(F.col("width_pt") * F.col("zoom")).cast("int"))
        .withColumn("page_height", F.round(F.col("height_pt") * F.col("zoom")).cast("int"))
    )


# Noise gate, contrast and threshold parameters of the image variants.
NOISE_VARIANCE, CLIP, TILES, WINDOW, OFFSET = 500.0, 3.0, 8, 31, 15


def laplacian_variance(gray: np.ndarray) -> float:
    """Variance of the Laplacian of a grey image; low values need denoising."""
    g = np.pad(gray.astype(float), 1, mode="reflect")
    lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return float(lap.var())


def needs_denoising(gray: np.ndarray) -> bool:
    return laplacian_variance(gray) < NOISE_VARIANCE


def otsu_threshold(gray: np.ndarray) -> int:
    """Grey level that separates two classes best."""
    n = np.bincount(gray.ravel(), minlength=256).astype(float)
    below, total = np.cumsum(n), n.sum()
    mean = np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = (mean[-1] * below / total - mean) ** 2 / (below * (total - below))
    return int(np.nan_to_num(spread, nan=0.0, posinf=0.0).argmax())


def adaptive_threshold(gray: np.ndarray, window: int = WINDOW, offset: float = OFFSET) -> np.ndarray:
    """Black and white by a Gaussian local mean."""
    sigma = 0.3 * ((window - 1) * 0.5 - 1) + 0.8
    at = np.arange(window) - window // 2
    kernel = np.exp(-(at**2) / (2 * sigma**2))
    kernel /= kernel.sum()
    padded = np.pad(gray.astype(float), window // 2, mode="edge")
    rows = np.apply_along_axis(np.convolve, 1, padded, kernel, "valid")
    mean = np.apply_along_axis(np.convolve, 0, rows, kernel, "valid")
    return np.where(gray > mean - offset, 255, 0).astype(np.uint8)


def equalise_tiles(gray: np.ndarray, tiles: int = TILES, clip: float = CLIP) -> np.ndarray:
    """Contrast-limited equalisation tile by tile, blended between tile centres."""
    h, w = gray.shape
    rows, cols = np.array_split(np.arange(h), min(tiles, h)), np.array_split(np.arange(w), min(tiles, w))
    maps = np.empty((len(rows), len(cols), 256))
    for i, r in enumerate(rows):
        for j, c in enumerate(cols):
            part = gray[r[0] : r[-1] + 1, c[0] : c[-1] + 1]
            n = np.bincount(part.ravel(), minlength=256).astype(float)
            most = max(1.0, clip * part.size / 256)
            over = np.maximum(n - most, 0).sum()
            maps[i, j] = 255 * np.cumsum(np.minimum(n, most) + over / 256) / part.size
    y = np.interp(np.arange(h), [r.mean() for r in rows], np.arange(len(rows)))
    x = np.interp(np.arange(w), [c.mean() for c in cols], np.arange(len(cols)))
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, len(rows) - 1), np.minimum(x0 + 1, len(cols) - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    pick = lambda a, b: maps[a[:, None], b[None, :], gray]
    top = pick(y0, x0) * (1 - fx) + pick(y0, x1) * fx
    low = pick(y1, x0) * (1 - fx) + pick(y1, x1) * fx
    return np.clip(np.round(top * (1 - fy) + low * fy), 0, 255).astype(np.uint8)
