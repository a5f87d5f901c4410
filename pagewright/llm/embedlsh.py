"""Near-duplicate embeddings: Euclidean p-stable hashing, then exact cosines.

Vectors are normalised, so a cosine of at least t is a distance of at most sqrt(2 - 2t).  A table hashes a
vector by several random projections, each shifted and cut into cells of fixed width; vectors with equal
cells share a bucket.  The number of projections follows the logarithm of the number of vectors (so that
buckets stay small) and the number of tables follows from the recall asked for.  Inside the buckets every
pair is compared exactly; buckets of any size are dealt out as pairs of blocks, and vectors travel in single
precision where that loses nothing.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, join_hot, prepare, stored, whole_partition
from .graph import connected_components, smallest_reachable

#: Cell width for unit vectors.
WIDTH = 1.5
#: Rows of a bucket that are compared in one piece; larger buckets are dealt out as pairs of blocks.
BLOCK = 1024
#: Groups of at least this size are compared by products of matrices.
MATRIX = 64


def cell_chance(distance: float, width: float = WIDTH) -> float:
    """Chance that two vectors at this distance fall into the same cell of one projection."""
    t = width / distance
    tail = 0.5 * math.erfc(t / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def plan_tables(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(projections in a table, tables) for n vectors that may meet each other."""
    near, far = cell_chance(math.sqrt(2 - 2 * threshold)), cell_chance(math.sqrt(2))
    # So many that a vector meets one unrelated vector in a table, and two more: a vector that meets nobody is not
    # sent anywhere, which saves more than the tables cost that make up for it.
    projections = max(2, math.ceil(math.log(max(n, 2)) / math.log(1 / far))) + 2
    return projections, math.ceil(math.log(1 - recall) / math.log(1 - near**projections))


def _projections(dim: int, count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((dim, count)), rng.uniform(0, WIDTH, count)


def _usable() -> Column:
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col("label").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def packed(v: np.ndarray) -> bytes:
    """The vector's bytes: a mark, then single precision where that loses nothing, else double."""
    with np.errstate(over="ignore"):
        short = v.astype("<f4")
    return b"f" + short.tobytes() if np.array_equal(short, v) else b"d" + v.tobytes()


def unpacked(raw: list[bytes], dim: int) -> np.ndarray:
    """Vectors of one dimension in double precision."""
    out = np.empty((len(raw), dim))
    for mark, kind in ((b"f", "<f4"), (b"d", "<f8")):
        own = [i for i, r in enumerate(raw) if r[:1] == mark]
        if own:
            out[own] = np.frombuffer(b"".join(raw[i][1:] for i in own), kind).reshape(len(own), dim)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _classes(rows: DataFrame) -> DataFrame:
    """``vec_id, label, dim, h1, h2, raw``: the vector's bytes and a 128-bit digest of its numbers."""

    def work(batches):
        for batch in batches:
            own = [np.asarray(v, "<f8") + 0.0 for v in batch.column(2).to_pylist()]  # -0 and 0 are one number
            halves = [divmod(xxhash.xxh3_128_intdigest(v.tobytes()), 1 << 64) for v in own]
            signed = [[x - (1 << 64) if x >> 63 else x for x in h] for h in halves]
            yield {
                "vec_id": batch.column(0),
                "label": batch.column(1),
                "dim": [len(v) for v in own],
                "h1": [h[0] for h in signed],
                "h2": [h[1] for h in signed],
                "raw": [packed(v) for v in own],
            }

    schema = "vec_id long, label long, dim int, h1 long, h2 long, raw binary"
    return whole_partition(rows.select("vec_id", "label", "v"), work, schema)


def _with_keys(reps: DataFrame, projections: int, tables: int, seed: int) -> DataFrame:
    """``rep, weight, raw, keys``: a 32-bit bucket key for each table, salted by label, dimension and table."""

    def work(batches):
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        mix = np.random.default_rng(seed).integers(1, 1 << 62, (tables, projections + 2), dtype=np.int64) | 1
        for batch in batches:
            dims = batch.column(3).to_numpy(zero_copy_only=False)
            labels = batch.column(2).to_numpy(zero_copy_only=False)
            raw = batch.column(4).to_pylist()
            keys = np.empty((len(raw), tables), np.uint32)
            for dim in np.unique(dims):
                if dim not in known:
                    known[dim] = _projections(int(dim), projections * tables, seed)
                own = np.flatnonzero(dims == dim)
                x = _unit(unpacked([raw[i] for i in own], int(dim)))
                cells = np.floor((x @ known[dim][0] + known[dim][1]) / WIDTH).astype(np.int64)
                with np.errstate(over="ignore"):
                    h = (cells.reshape(len(own), tables, projections) * mix[:, :projections]).sum(axis=2)
                    h += labels[own, None] * mix[:, projections] + int(dim) * mix[:, projections + 1]
                    h ^= h >> 29
                    h *= np.int64(0x3C79AC492BA7B653)
                keys[own] = (h >> 32).astype(np.uint32)
            yield {
                "rep": batch.column(0),
                "weight": batch.column(1),
                "label": batch.column(2),
                "dim": batch.column(3),
                "raw": batch.column(4),
                "keys": [k.tobytes() for k in keys],
            }

    return whole_partition(
        reps.select("rep", "weight", "label", "dim", "raw"),
        work,
        "rep long, weight long, label long, dim int, raw binary, keys binary",
    )


def _buckets(keyed: DataFrame, tables: int) -> DataFrame:
    """``bucket, slot, rep`` of every vector in every table.

    A bucket is a 64-bit hash of label, dimension, table and key.  Where two of these share it, they are told apart
    when vectors are compared.
    """

    def work(batches):
        for batch in batches:
            n = batch.num_rows
            keys = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u4").reshape(n, tables).astype(np.int64)
            label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            dim = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            with np.errstate(over="ignore"):
                h = (label[:, None] ^ dim[:, None] << 40) + (keys << 20 | np.arange(tables)) * np.int64(0x1E3779B97F4A7C15)
                h = (h ^ h >> 31) * np.int64(0x3C79AC492BA7B653)
                h ^= h >> 27
            yield {
                "bucket": h.reshape(-1),
                "slot": np.tile(np.arange(tables, dtype=np.int32), n),
                "rep": np.repeat(batch.column(0).to_numpy(zero_copy_only=False), tables),
            }

    return whole_partition(keyed.select("rep", "label", "dim", "keys"), work, "bucket long, slot int, rep long")


def _earlier(keys: list[bytes], slot: np.ndarray, tables: int) -> np.ndarray:
    """The keys of the tables before the row's own, zeros after them."""
    out = np.zeros((len(keys), tables), np.uint32)
    for k in np.unique(slot):
        own = np.flatnonzero(slot == k)
        out[own, :k] = np.frombuffer(b"".join([keys[i] for i in own]), "<u4").reshape(len(own), k)
    return out


def _near(x: np.ndarray, group: np.ndarray, side: np.ndarray, threshold: float):
    """Pairs of rows of one group, as arrays of the first and the second, whose cosine reaches the threshold.

    The rows come sorted by group.  Blocks i and j of one bucket: inside a block only its own piece (i, i) compares.
    """
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(starts, len(group)))
    at = np.flatnonzero(np.repeat(sizes < MATRIX, sizes))
    for step in range(1, MATRIX):
        at = at[at + step < len(group)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            break
        pairs = at[(side[at] != side[at + step]) | (side[at] == 2)]
        for p in np.array_split(pairs, max(1, len(pairs) // 8192)):
            near = np.einsum("ij,ij->i", x[p], x[p + step]) >= threshold
            if near.any():
                yield p[near], p[near] + step
    for start, size in zip(starts[sizes >= MATRIX], sizes[sizes >= MATRIX]):
        own = np.arange(start, start + size)
        left, right = own[side[own] != 1], own[side[own] != 0]
        for part in np.array_split(left, max(1, len(left) // 256)):
            p, q = np.nonzero(x[part] @ x[right].T >= threshold)
            p, q = part[p], right[q]
            once = (side[p] != side[q]) | (p < q)
            yield p[once], q[once]


def _compare(rows: DataFrame, tables: int, threshold: float) -> DataFrame:
    """Exact comparison inside ``(bucket, i, j, label, dim, slot)``, which the rows come sorted by.

    Gives ``kind 0, a, n``: weight that vector a is linked with, and ``kind 1, a, b``: edges that span the
    linked vectors.  A pair that meets in several tables counts in the first of them alone.
    """

    def flush(held: list[dict]) -> dict | None:
        if not held:
            return None
        group = np.concatenate([h["group"] for h in held])
        rep, weight, side = (np.concatenate([h[k] for h in held]) for k in ("rep", "weight", "side"))
        slot = np.concatenate([h["slot"] for h in held])
        dims = np.concatenate([h["dim"] for h in held])
        keys = np.concatenate([h["keys"] for h in held])
        raw = [r for h in held for r in h["raw"]]
        links = np.zeros(len(rep), np.int64)
        edge_a, edge_b = [], []
        for dim in np.unique(dims):
            own = np.flatnonzero(dims == dim)
            x = _unit(unpacked([raw[i] for i in own], int(dim)))
            g, r, w, s, t, k = (v[own] for v in (group, rep, weight, side, slot, keys))
            for p, q in _near(x, g, s, threshold):
                before = (k[p] == k[q]) & (np.arange(tables)[None, :] < t[p][:, None])
                first = ~before.any(axis=1) & (r[p] != r[q])
                p, q = p[first], q[first]
                for a, b in ((p, q), (q, p)):
                    np.add.at(links, own[a], w[b])
                edge_a.append(r[p])
                edge_b.append(r[q])
        a = np.concatenate([*edge_a, np.empty(0, np.int64)])
        b = np.concatenate([*edge_b, np.empty(0, np.int64)])
        nodes, low = smallest_reachable(a, b)
        span = nodes != low
        known, place = np.unique(rep[links > 0], return_inverse=True)
        counts = np.zeros(len(known), np.int64)
        np.add.at(counts, place, links[links > 0])
        return {
            "kind": np.concatenate([np.zeros(len(known), np.int32), np.ones(int(span.sum()), np.int32)]),
            "a": np.concatenate([known, nodes[span]]),
            "b": np.concatenate([counts, low[span]]),
        }

    def work(batches):
        held, rows_held, last, number = [], 0, None, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                cols = {f: part.column(f).to_numpy(zero_copy_only=False) for f in ("label", "dim", "slot", "bucket", "i", "j")}
                ids = np.stack([cols[f].astype(np.int64) for f in cols], axis=1)
                new = np.ones(len(ids), bool)
                new[1:] = (ids[1:] != ids[:-1]).any(axis=1)
                new[0] = last is None or (ids[0] != last).any()
                group = number + np.cumsum(new)
                if new[0] and rows_held >= 4096:
                    yield flush(held)
                    held, rows_held = [], 0
                elif rows_held >= 4096 and new.any():  # end the pieces held at the first new group
                    cut = int(np.flatnonzero(new)[0])
                    held.append(_slice(part, group, cols, 0, cut))
                    yield flush(held)
                    held, rows_held = [_slice(part, group, cols, cut, len(ids))], len(ids) - cut
                    number, last = int(group[-1]), ids[-1]
                    continue
                held.append(_slice(part, group, cols, 0, len(ids)))
                rows_held += len(ids)
                number, last = int(group[-1]), ids[-1]
        if held:
            yield flush(held)

    def _slice(part, group, cols, a, b):
        cut = part.slice(a, b - a)
        return {
            "group": group[a:b],
            "rep": cut.column("rep").to_numpy(zero_copy_only=False),
            "weight": cut.column("weight").to_numpy(zero_copy_only=False),
            "side": cut.column("side").to_numpy(zero_copy_only=False),
            "slot": cols["slot"][a:b],
            "dim": cols["dim"][a:b],
            "keys": _earlier(cut.column("keys").to_pylist(), cols["slot"][a:b], tables),
            "raw": cut.column("raw").to_pylist(),
        }

    return whole_partition(rows, work, "kind int, a long, b long")


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.93,
    recall: float = 0.99,
    seed: int = 1,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Two vectors link if their labels are equal and not null and their cosine is at least ``threshold``.
    ``recall`` is the chance that a pair exactly at the threshold is found; closer pairs are likelier, and
    no pair below the threshold is ever linked.  Equal vectors of a label are one class with a weight
    (so thousands of copies cost one vector) and link with each other.  Vectors that are null, all
    zero, or hold null or non-finite numbers link with nothing, nor do vectors of different
    dimensions.  Repeated rows count as vectors of their own; other columns are ignored.
    """
    prepare(vectors.sparkSession)
    rows = vectors.select(
        F.col(id_column).cast("long").alias("vec_id"),
        F.when(F.col(label_column).isNotNull(), F.xxhash64(F.col(label_column).cast("string"))).alias("label"),
        F.col(vector_column).cast("array<double>").alias("v"),
    ).withColumn("ok", F.coalesce(_usable(), F.lit(False)))
    members = stored(_classes(rows.filter("ok")), "vectors")
    key = ["label", "dim", "h1", "h2"]
    reps = (
        members.groupBy(*key)
        .agg(F.min("vec_id").alias("smallest"), F.count(F.lit(1)).alias("weight"), F.first("raw").alias("raw"))
        .withColumn("rep", F.xxhash64(*key))
    )
    most = members.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    projections, tables = plan_tables(most, threshold, recall)
    keyed = stored(_with_keys(reps, projections, tables, seed), "vector-keys")

    bucket = ["bucket"]
    places = _buckets(keyed, tables)
    shared = stored(places.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    # Block b takes part in the pieces (b, j) and (i, b).  Side 0 and 1 are the two blocks of a piece; side 2
    # is a piece of one block alone.
    placed = (
        places.join(broadcast_if_small(shared), bucket)
        .withColumn("blocks", blocks)
        .withColumn("block", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            *bucket,
            "slot",
            "rep",
            F.least("block", "other").alias("i"),
            F.greatest("block", "other").alias("j"),
            F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"),
        )
    )
    # A pair counts in its first table, so a row needs its keys only up to its own one.
    full = placed.join(keyed.select("rep", "label", "dim", "weight", "raw", "keys"), "rep").withColumn("keys", F.expr("substring(keys, 1, slot * 4)"))
    piece = [*bucket, "i", "j"]
    compared = stored(
        _compare(full.repartition(*piece).sortWithinPartitions(*piece, "label", "dim", "slot"), tables, threshold), "vector-links"
    )
    linked = compared.filter("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("others"))
    components = connected_components(compared.filter("kind = 1").select("a", "b"))
    found = (
        reps.select(*key, "rep", "weight", "smallest")
        .join(linked, "rep", "left")
        .join(components.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            *key,
            "smallest",
            F.col("weight").alias("members"),
            (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rep").alias("component"),
        )
    )
    found = stored(found, "vector-classes")
    named = found.groupBy("component").agg(F.min("smallest").alias("component_id"), F.count(F.lit(1)).alias("members"))
    total = members.count()
    placed = join_hot(found.drop("smallest").withColumnRenamed("members", "weight"), stored(named, "vector-components"), ["component"], total)
    # A class is alone if it is one vector without links: such rows keep their own id and need no join.
    classes = placed.select(*key, F.col("weight").alias("members"), "n_links", "component_id").filter("members > 1 OR n_links > 0")
    joined = join_hot(members.select("vec_id", *key), stored(classes, "linked-vectors"), key, total)
    linked_rows = joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("members").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")
    )
    alone = rows.filter(~F.col("ok")).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked_rows.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
