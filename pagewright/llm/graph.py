"""Connected components of an edge list, without gathering an unbounded one anywhere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, prepare, stored, whole_partition, write_table


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node reachable from each) of the edges a-b, in memory."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        low, high = np.minimum(rx, ry), np.maximum(rx, ry)
        apart = low != high
        if not apart.any():
            return nodes, nodes[root]
        x, y = x[apart], y[apart]
        np.minimum.at(root, high[apart], low[apart])
        while not np.array_equal(after := root[root], root):
            root = after


def forest(edges: DataFrame) -> DataFrame:
    """Each task's edges replaced by stars with the same components: at most one row for each node.

    A node that occurs only in loops keeps one loop.
    """

    def work(batches):
        a, b = np.empty(0, np.int64), np.empty(0, np.int64)
        loops = np.empty(0, np.int64)
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            loops = np.unique(np.concatenate([loops, x[x == y]]))
            nodes, low = smallest_reachable(np.concatenate([a, x[x != y]]), np.concatenate([b, y[x != y]]))
            keep = nodes != low
            a, b = nodes[keep], low[keep]
        loops = np.setdiff1d(loops, np.concatenate([a, b]))
        yield {"a": np.concatenate([a, loops]), "b": np.concatenate([b, loops])}

    return whole_partition(edges, work, "a long, b long")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).filter(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame, one_task: int = 2_000_000) -> DataFrame:
    """``node, component`` for every node of ``edges`` (first two columns); the component is its smallest node.

    Every round shrinks the edges to a forest in each task.  Once at most ``one_task`` edges are left, one
    task finishes them.  Larger graphs go on by alternating large-star and small-star rounds, whose
    state is a written table, until nothing changes.  Edges with a null end are ignored; a node that
    occurs only in a loop is its own component.
    """
    prepare(edges.sparkSession)
    spark = edges.sparkSession
    a, b = (F.col(c).cast("long") for c in edges.columns[:2])
    # The edges are read once: whatever they were computed by does not run again.
    path = write_table(forest(edges.select(a.alias("a"), b.alias("b")).dropna()), "edges")
    first = spark.read.schema("a long, b long").parquet(path)
    loops = first.filter("a = b").select(F.col("a").alias("node"))
    kept, state = path, None
    while True:
        now = spark.read.schema("a long, b long").parquet(path).filter("a <> b")
        n, mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if n <= one_task:
            stars = forest(now.coalesce(1)) if n else now
            break
        if (n, mark) == state:
            stars = now
            break
        state = (n, mark)
        after = write_table(_small_star(_large_star(now)), "edges")
        if path != kept:
            drop_table(spark, path)
        path = after
    found = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # A node has one row at most among the stars; roots and lone loops stand for themselves.
    roots = found.select(F.col("component").alias("node")).union(loops)
    every = found.union(roots.select("node", F.col("node").alias("component")))
    return stored(every.groupBy("node").agg(F.min("component").alias("component")), "components")
