"""Operators on pairs of blocks of one page: suppression, duplicates, captions, merging two engines.

Every pair shares its page, so all joins are hash joins on the page with a geometric residual, and the
work of a page never leaves its partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, STRUCTURE_TYPES, Settings
from ..functions import geometry as G
from ..functions import text as X
from .blocks import PAGE, by_page

CAPTION = "(?i)^(figure|fig\\.|table)\\s*\\d+"


def _side(df: DataFrame, mark: str) -> DataFrame:
    return df.select(*PAGE, *(F.col(c).alias(f"{mark}_{c}") for c in df.columns if c not in PAGE))


def suppress_inside(blocks: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Blocks without the texts that lie inside a table or figure of their page.

    Structures and blocks without a box always stay.  The boxes of a page's structures are gathered beside its
    blocks, so the blocks themselves are dealt by page once and joined with nothing.
    """
    structure = F.coalesce(F.col("type"), F.lit("")).isin(*STRUCTURE_TYPES)
    boxes = F.collect_list(F.when(structure & F.col("bbox").isNotNull(), F.col("bbox"))).over(Window.partitionBy(*PAGE))
    inside = F.exists("_boxes", lambda box: G.containment(F.col("bbox"), box) >= s.containment)
    kept = structure | F.col("bbox").isNull() | ~F.coalesce(inside, F.lit(False))
    return blocks.withColumn("_boxes", boxes).filter(kept).drop("_boxes")


def duplicate_edges(blocks: DataFrame, similarity: Column | None = None, s: Settings = DEFAULT) -> DataFrame:
    """Pairs of text blocks of one type that overlap and read alike: ``a_seq < b_seq``.

    ``similarity`` is an expression on ``a_text, b_text``; by default the gestalt ratio.
    """
    texts = blocks.filter(~F.col("type").isin(*STRUCTURE_TYPES) & F.col("bbox").isNotNull())
    a, b = (_side(texts.select(*PAGE, "seq", "type", "text", "bbox", "confidence"), m) for m in "ab")
    on = [F.col("a_type") == F.col("b_type"), F.col("a_seq") < F.col("b_seq")]
    near = a.join(b, PAGE).filter(on[0] & on[1] & (G.iou(F.col("a_bbox"), F.col("b_bbox")) >= s.duplicate_iou))
    like = X.gestalt_similarity(F.col("a_text"), F.col("b_text"), s.duplicate_similarity) if similarity is None else similarity
    return near.withColumn("similarity", like).filter(F.col("similarity") >= s.duplicate_similarity)


def _fields(df: DataFrame, *names: str) -> list[T.StructField]:
    return [T.StructField(n, df.schema[n].dataType) for n in names]


def duplicate_clusters(edges: DataFrame) -> DataFrame:
    """``seq, cluster, best`` of every block with an edge: the smallest ``seq`` that it reaches over edges of its page,
    and the most confident block of that cluster, the first one on ties.

    A page is one unit of layout, so its edges are closed at once; blocks without edges do not go through it.
    """

    def close(rows: list[dict]) -> list[tuple]:
        root: dict[int, int] = {}
        sure: dict[int, float] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for r in rows:
            low, high = sorted((find(r["a_seq"]), find(r["b_seq"])))
            root[high] = low
            sure[r["a_seq"]], sure[r["b_seq"]] = r["a_confidence"], r["b_confidence"]
        best: dict[int, int] = {}
        for x in sorted(sure, key=lambda x: (-sure[x], x)):
            best.setdefault(find(x), x)
        page = [rows[0][c] for c in PAGE]
        return [(*page, x, find(x), best[find(x)]) for x in sure]

    whole = [T.StructField(n, T.IntegerType()) for n in ("seq", "cluster", "best")]
    ends = [F.col(f"{m}_seq").cast("int").alias(f"{m}_seq") for m in "ab"]
    sure = [F.coalesce(f"{m}_confidence", F.lit(0.0)).cast("double").alias(f"{m}_confidence") for m in "ab"]
    slim = edges.select(*PAGE, *ends, *sure)
    return by_page(slim, [], close, T.StructType([*_fields(edges, *PAGE), *whole]))


def merge_duplicates(blocks: DataFrame, similarity: Column | None = None, s: Settings = DEFAULT) -> DataFrame:
    """Of each cluster of duplicates the most confident block, the first one on ties."""
    found = duplicate_clusters(duplicate_edges(blocks, similarity, s))
    return blocks.join(found.filter("seq <> best").select(*PAGE, "seq"), [*PAGE, "seq"], "left_anti")


def with_captions(regions: DataFrame, texts: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """``regions`` with the nearest caption text of their page, or null.

    A caption begins like "Figure 1", meets the region horizontally and is at most ``caption_gap`` away; on
    equal gaps the last text wins.
    """
    words = X.strip(F.col("text"))
    candidates = _side(
        texts.filter(words.rlike(CAPTION) & F.col("bbox").isNotNull()).select(
            *PAGE, "seq", "bbox", words.alias("caption")
        ),
        "t",
    )
    gap = G.vertical_gap(F.col("bbox"), F.col("t_bbox"))
    near = regions.select(*PAGE, "seq", "bbox").join(candidates, PAGE).filter(
        G.touches_horizontally(F.col("bbox"), F.col("t_bbox")) & (gap <= s.caption_gap)
    )
    # The smallest gap, then the largest seq: the maximum of (-gap, seq).
    best = near.groupBy(*PAGE, "seq").agg(F.max_by("t_caption", F.struct(-gap, F.col("t_seq"))).alias("caption"))
    return regions.drop("caption").join(best, [*PAGE, "seq"], "left")


def merge_engines(primary: DataFrame, fallback: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Merge two engines' blocks page by page.

    Each fallback block in order takes the unused primary block of highest overlap (the first on ties); from
    ``merge_iou`` on the strictly more confident primary or else the fallback stands for both.  Unused
    primary blocks follow.  Each choice depends on the choices before, so a page is folded as a whole.  Pages
    that only one engine has pass through it unchanged.
    """
    columns = ("seq", "text", "x0", "y0", "x1", "y1", "confidence", "language", "type")

    def flat(df: DataFrame, side: int) -> DataFrame:
        have = set(df.columns)
        box = [F.col(f"bbox.{e}").alias(e) for e in ("x0", "y0", "x1", "y1")]
        rest = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in ("language", "type")]
        return df.select(*PAGE, F.lit(side).alias("_side"), F.col("seq").cast("int").alias("seq"), "text", *box, "confidence", *rest)

    def size(r: dict) -> float:
        return max(0.0, r["x1"] - r["x0"]) * max(0.0, r["y1"] - r["y0"])

    def overlap(a: dict, b: dict) -> float:
        wide, high = min(a["x1"], b["x1"]) - max(a["x0"], b["x0"]), min(a["y1"], b["y1"]) - max(a["y0"], b["y0"])
        both = wide * high if wide > 0 and high > 0 else 0.0
        return both / (size(a) + size(b) - both) if both else 0.0

    def fold(rows: list[dict]) -> list[tuple]:
        open_ = [r for r in rows if r["_side"] == 0]
        out = []
        for f in (r for r in rows if r["_side"] == 1):
            shares = [overlap(f, p) for p in open_]
            best = max(shares, default=0.0)
            if best > 0 and best >= s.merge_iou:
                p = open_.pop(shares.index(best))  # the first of equals
                out.append((p, "primary") if p["confidence"] > f["confidence"] else (f, "fallback"))
            else:
                out.append((f, "fallback"))
        out += [(p, "primary") for p in open_]
        page = [rows[0][c] for c in PAGE]
        return [(*page, i, *(r[c] for c in columns[1:]), engine) for i, (r, engine) in enumerate(out)]

    both = flat(primary, 0).unionByName(flat(fallback, 1))
    schema = T.StructType([*_fields(both, *PAGE, *columns), T.StructField("engine_used", T.StringType())])
    merged = by_page(both, ["_side", "seq"], fold, schema)
    box = G.bbox(*(F.col(e) for e in ("x0", "y0", "x1", "y1")))
    return merged.withColumn("bbox", box).drop("x0", "y0", "x1", "y1")
