"""Jaccard similarity join of documents on word shingles.

The Jaccard distance is a metric.  Documents that share no shingle are all equally far from each other, so no pivot
tells them apart; a first step therefore finds the regions that links cannot leave, and each region is joined by pivots:

1.  Equal sets become one class.  Shingles that many classes share get a level by how common they are.
2.  Meetings.  A set has its shingles in the order of (level, hash).  Of two sets that are linked, the first
    ``n - ceil(t n) + 1`` shingles share one at least.  Sets that meet at a shingle form a region, transitively,
    if their sketches (one bit of each of 256 minimum hashes) are near enough.  A pair at the threshold fails that
    with a chance below 2^-64, the chance that two given shingles have the same 64-bit hash.
3.  Voronoi cells.  Some documents of a region are its pivots, and the distances to them are computed on whole sets.
    What lies within the threshold of a pivot is linked with it.  Every document belongs to the cell of its nearest
    pivot, or to the remote cell if that is too far.  By the triangle inequality two linked documents
    of different cells have distances to any pivot that differ by no more than the threshold, so a document is
    replicated to an earlier cell if that pivot is at most twice the threshold further away than its own.
4.  Cells are joined in the same way, recursively, with pivots of their own; a small one in memory, where also the
    windows of step 2 are taken anew in exact order of rarity.  What no pivot divides is joined in blocks.
    Documents known to be connected are not compared with each other.

The links found span the same components as all links.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, drop_table, join_hot, map_rows, prepare, stored, whole_partition, write_table
from .graph import connected_components, smallest_reachable

#: Shingles gathered in a task before they are counted, and pivots before they are combined: bounds its memory.
COUNTED, CHUNK = 1_000_000, 500_000
#: Most shingles that get a level of their own.  A bound of memory; any order of pivots is exact.
MOST_LEVELS = 400_000
#: Minimum hashes of a sketch; the most chance that a pair at the threshold differs in more bits than allowed; and the
#: bits within which a sketch is represented by another one at the same pivot of the same chunk.  Across chunks both
#: sets may be represented, so the bound there is wider by twice as much.
SKETCH, SKETCH_MISS, SKETCH_NEAR = 256, 2.0**-64, 4
#: Rows that are compared together at a shingle, and the group size from which comparison goes by leaders.
MEETING_ROWS, MEETING_GROUP = 50_000, 256
#: A shingle that 2 to this power classes hold or more is dealt to several tasks, as pairs of blocks.
MEETING_LEVEL = 17
#: A region with more sets or shingles than this is divided by pivots across tasks.
REGION_SETS, REGION_SHINGLES = 1_000, 1_000_000
#: Pivots of a region, the most shingles that one may have, and the size from which memory takes several at once.
PIVOTS, PIVOT_SHINGLES, SEVERAL = 8, 100_000, 64
#: Cells are joined as such if each has at most this share of its region's sets, and all together this many times.
SHRINK, GROW = 0.8, 2

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = int(_RNG.integers(0, 1 << 62)) * 2 + 1
_PLACE = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_ORDERS = _RNG.integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


_POWERS = np.ones(1024, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n or _POWERS[1] == 1:
        out = np.full(max(n, 1024), np.uint64(_STEP % (1 << 64)))
        out[0] = 1
        _POWERS = np.cumprod(out, dtype=np.uint64)
    return _POWERS


def shingle_sets(texts: list[str | None], words: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text.

    A-Z are lower-cased; words are runs of bytes other than space and the controls 9 to 13.  A text with
    fewer words than a shingle has its whole sequence as its only one; without words the set is empty.
    """
    raw = [(t or "").encode().lower() for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    solid = ~_SPACE[data]
    at = np.flatnonzero(solid)
    if not len(at):
        return [np.empty(0, np.uint64) for _ in raw]
    new = np.concatenate([[True], np.diff(at) > 1])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, length)
    word = _mixed(np.add.reduceat(_BYTE[data[at]] * _powers(int(length.max()))[place], first))
    bounds = np.searchsorted(at[first], begin)
    count = len(word) - words + 1
    if count > 0:
        joined = word[:count] * _PLACE[0]
        for k in range(1, words):
            joined = joined + word[k : k + count] * _PLACE[k]
        joined = _mixed(joined)
    out = []
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= words:
            out.append(np.unique(joined[a : b - words + 1]))
        elif b > a:
            terms = np.append(word[a:b] * _PLACE[: b - a], _PLACE[63:] * np.uint64(b - a))
            out.append(_mixed(terms.sum(dtype=np.uint64, keepdims=True)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed numbers."""
    d = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def window(n: int, percent: int) -> int:
    """How many first pivots of a set of n must be looked at: n - ceil(percent n / 100) + 1."""
    return n - -(-percent * n // 100) + 1


class _Levels:
    """Levels of the common shingles; 0 for all others.  A bitmap answers most questions at once."""

    def __init__(self, keys: np.ndarray, levels: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.levels = keys[order], levels[order]
        self.bitmap = np.zeros(1 << 22, bool)
        self.bitmap[keys >> np.uint64(42)] = True

    def of(self, shingles: np.ndarray) -> np.ndarray:
        out = np.zeros(len(shingles), np.uint8)
        maybe = np.flatnonzero(self.bitmap[shingles >> np.uint64(42)])
        if len(maybe):
            own = shingles[maybe]
            at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
            out[maybe] = np.where(self.keys[at] == own, self.levels[at], 0)
        return out

    def first(self, shingles: np.ndarray, percent: int) -> np.ndarray:
        """The pivots inside the window of a sorted set."""
        n = window(len(shingles), percent)
        levels = self.of(shingles)
        if not levels.any():
            return shingles[:n]
        return shingles[np.argsort(levels, kind="stable")[:n]]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _text_batches(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[tuple[list, list]]:
    for big in batches:
        for at in range(0, big.num_rows, rows):
            part = big.slice(at, rows)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()


def _sets_and_counts(docs: DataFrame, words: int) -> DataFrame:
    """Rows of two kinds: ``doc_id, n, h1, h2`` of each document; ``shingle, n`` of shingles that several
    classes of a chunk hold (``kind`` 1)."""
    schema = "kind int, doc_id long, n long, h1 long, h2 long, shingle long"

    def common(held: list[np.ndarray]) -> dict:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        many = counts >= 2
        keys, counts = keys[many], counts[many]
        none = [None] * len(keys)
        return {"kind": [1] * len(keys), "doc_id": none, "n": counts, "h1": none, "h2": none, "shingle": _signed(keys)}

    def work(batches):
        seen: set[int] = set()
        held, size = [], 0
        for ids, texts in _text_batches(batches):
            sets = shingle_sets(texts, words)
            names = [signature(s) for s in sets]
            yield {
                "kind": [0] * len(ids),
                "doc_id": ids,
                "n": [len(s) for s in sets],
                "h1": [x for x, _ in names],
                "h2": [y for _, y in names],
                "shingle": [None] * len(ids),
            }
            for s, (h1, _) in zip(sets, names):
                if len(s) and h1 not in seen:
                    seen.add(h1)
                    held.append(s)
                    size += len(s)
            if size >= COUNTED:
                yield common(held)
                held, size = [], 0
        if held:
            yield common(held)

    return whole_partition(docs, work, schema)


def _levels(counts: DataFrame) -> _Levels:
    """The commonest shingles, at most MOST_LEVELS, with the logarithm of their count as level."""
    level = (F.floor(F.log2("n")) + 1).cast("int")
    table = counts.groupBy("shingle").agg(F.sum("n").alias("n")).select("shingle", level.alias("level"))
    found = write_table(table, "levels")
    table = counts.sparkSession.read.schema(table.schema).parquet(found)
    sizes = {r["level"]: r["count"] for r in table.groupBy("level").count().collect()}
    total, least = 0, 65
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > MOST_LEVELS:
            break
        least = k
    rows = table.filter(F.col("level") >= least).toArrow()
    drop_table(counts.sparkSession, found)
    keys = rows.column("shingle").to_numpy().view(np.uint64)
    return _Levels(keys, rows.column("level").to_numpy().astype(np.uint8))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """One bit of the minimum hash in each of 256 orders, as four numbers."""
    low = np.full(SKETCH, np.iinfo(np.uint64).max)
    spread = shingles ^ (shingles >> np.uint64(32))
    for at in range(0, len(spread), 256):
        np.minimum(low, (spread[at : at + 256, None] * _ORDERS).min(axis=0), out=low)
    return np.packbits((low >> np.uint64(20) & np.uint64(1)).astype(np.uint8)).view(np.uint64)


@functools.lru_cache
def sketch_bits(percent: int) -> int:
    """Bits in which sketches of linked sets may differ: a bit differs with a chance of half the distance.

    Low thresholds give bounds that nearly all pairs pass; the sketches then no longer divide, but lose nothing.
    """
    p, past, most = (1 - percent / 100) / 2, 0.0, SKETCH
    while most and (past := past + comb(SKETCH, most) * p**most * (1 - p) ** (SKETCH - most)) <= SKETCH_MISS:
        most -= 1
    return most


def _node(keys: np.ndarray) -> np.ndarray:
    """64-bit name of a sketch.  Equal names only put sets into one region, where they are compared whole."""
    out = keys[:, 0]
    for k in range(1, keys.shape[1]):
        out = _mixed(out * _PLACE[k] + _mixed(keys[:, k]))
    return _signed(out)


def _apart(keys: np.ndarray, i, j) -> np.ndarray:
    """Differing bits of sketches i and j."""
    return np.bitwise_count(keys[i] ^ keys[j]).sum(axis=-1, dtype=np.int16)


def meeting_edges(pivot: np.ndarray, keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (by number) of one pivot whose sketches differ in at most ``most`` bits.

    The rows are sorted by pivot.  Pairs that are connected anyway may be missing: small groups are compared
    whole, in large ones leaders are taken from outside the largest component until all are connected or
    all have been leaders.
    """
    starts = np.flatnonzero(np.concatenate([[True], pivot[1:] != pivot[:-1]]))
    sizes = np.diff(np.append(starts, len(pivot)))
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= MEETING_GROUP), sizes))
    step = 0
    while len(at):
        step += 1
        at = at[at + step < len(pivot)]
        at = at[pivot[at] == pivot[at + step]]
        near = at[_apart(keys, at, at + step) <= most]
        left.append(near)
        right.append(near + step)
    for start, size in zip(starts[sizes > MEETING_GROUP], sizes[sizes > MEETING_GROUP]):
        open_, part = np.arange(start, start + size), np.arange(size)
        while len(open_) > 1:
            labels, place = np.unique(part, return_inverse=True)
            if len(labels) == 1:
                break
            lead = int(np.flatnonzero(place != np.bincount(place).argmax())[0])
            near = _apart(keys, open_, open_[lead]) <= most
            left.append(np.full(int(near.sum()) - 1, open_[lead]))
            right.append(open_[near & (np.arange(len(open_)) != lead)])
            part[np.isin(part, part[near])] = part[lead]
            open_, part = np.delete(open_, lead), np.delete(part, lead)
    return np.concatenate(left), np.concatenate(right)


def spread_pivots(pivot: np.ndarray, node: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of each task that a row of a pivot goes to.

    A pivot with one block is its own key.  With several, the node gives the row's block, and the row goes to
    every pair that holds this block, so any two rows of the pivot meet under some key.
    """
    row = np.repeat(np.arange(len(pivot)), blocks)
    first = np.cumsum(blocks) - blocks
    other = np.arange(len(row)) - first[row]
    many = blocks[row].astype(np.uint64)
    own = node.view(np.uint64)[row] % many
    low, high = np.minimum(own, other.astype(np.uint64)), np.maximum(own, other.astype(np.uint64))
    salted = _mixed(pivot[row] + _mixed((low * many + high + np.uint64(1)) * _PLACE[0]))
    return np.where(many > 1, salted, pivot[row]), row


def _meetings(docs: DataFrame, levels, words: int, percent: int) -> DataFrame:
    """Rows of three kinds.  0: ``a = pivot, b, c, d, e = sketch`` of a class in whose window the pivot is; of classes
    of a chunk with almost equal sketches one stands for all.  1: ``a, b``: nodes of a chunk that meet at a
    pivot.  2: ``a = class, b = node``."""

    def combine(held: list[np.ndarray], marks: list[np.ndarray], names: list[int]) -> dict:
        own = np.array(marks)
        node = _node(own)
        pivot = np.concatenate(held)
        row = np.repeat(np.arange(len(held)), [len(h) for h in held])
        order = np.lexsort((own[row, 0], pivot))
        pivot, row = pivot[order], row[order]
        keys = own[row]
        x, y = meeting_edges(pivot, keys, sketch_bits(percent) + SKETCH_NEAR)
        edges = np.unique(np.stack([node[row[x]], node[row[y]]]), axis=1)
        # A row goes if the first row of its pivot is almost equal to it.
        new = np.concatenate([[True], pivot[1:] != pivot[:-1]])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        stays = new | (_apart(keys, np.arange(len(row)), first) > SKETCH_NEAR)
        pivot, keys, row = pivot[stays], keys[stays], row[stays]
        level = levels.value.of(pivot).astype(np.int64)
        pivot, dealt = spread_pivots(pivot, node[row], 1 << np.maximum(level - MEETING_LEVEL, 0))
        keys = keys[dealt]
        n, m, k = len(pivot), edges.shape[1], len(names)
        none = np.zeros(m + k, np.int64)
        return {
            "kind": np.repeat(np.array([0, 1, 2], np.int32), [n, m, k]),
            "a": np.concatenate([_signed(pivot), edges[0], np.array(names, np.int64)]),
            "b": np.concatenate([_signed(keys[:, 0].copy()), edges[1], node]),
            **{c: np.concatenate([_signed(keys[:, i].copy()), none]) for i, c in enumerate("cde", 1)},
        }

    def work(batches):
        table: _Levels = levels.value
        seen: set[int] = set()
        held, marks, names, size = [], [], [], 0
        for _, texts in _text_batches(batches):
            for s in shingle_sets(texts, words):
                if not len(s):
                    continue
                h1 = signature(s)[0]
                if h1 in seen:
                    continue
                seen.add(h1)
                held.append(table.first(s, percent))
                marks.append(sketch(s))
                names.append(h1)
                size += len(held[-1])
            if size >= CHUNK:
                yield combine(held, marks, names)
                held, marks, names, size = [], [], [], 0
        if held:
            yield combine(held, marks, names)

    return whole_partition(docs, work, "kind int, a long, b long, c long, d long, e long")


def _meeting_edges(postings: DataFrame, percent: int = 80) -> DataFrame:
    """Nodes that meet at a pivot across all chunks: ``a, b``, a forest for each stretch of rows."""

    def work(batches):
        held, rows, full = [], 0, MEETING_ROWS

        def flush(cols: list[np.ndarray]) -> dict:
            keys = np.stack(cols[1:], axis=1)
            x, y = meeting_edges(cols[0], keys, sketch_bits(percent) + 2 * SKETCH_NEAR)
            node = _node(keys)
            nodes, low = smallest_reachable(node[x], node[y])
            return {"a": nodes[nodes != low], "b": low[nodes != low]}

        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(5)])
            rows += batch.num_rows
            if rows >= full:
                cols = [np.concatenate(c) for c in zip(*held)]
                last = np.searchsorted(_signed(cols[0]), _signed(cols[0])[-1])  # its pivot may go on
                if last:
                    yield flush([c[:last] for c in cols])
                held, rows = [[c[last:] for c in cols]], len(cols[0]) - last
                full = max(MEETING_ROWS, 2 * rows)
        if held:
            yield flush([np.concatenate(c) for c in zip(*held)])

    dealt = postings.select(*"abcde").repartition("a").sortWithinPartitions("a")
    return whole_partition(dealt, work, "a long, b long")


def _linked(p: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of p with each of the sets that lie one after another in ``flat``."""
    at = np.minimum(np.searchsorted(p, flat), len(p) - 1)
    return np.add.reduceat((p[at] == flat).astype(np.int64), starts) if len(flat) else np.zeros(len(sizes), np.int64)


def region_links(sets: list[np.ndarray], percent: int, joined: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that span the components of one region, by recursion and distances to pivots.

    ``joined`` holds numbers that are equal for sets known to be connected already.
    """
    out: list[tuple[int, int]] = []
    root = np.arange(len(sets)) if joined is None else np.unique(joined, return_inverse=True)[1]
    size_of = np.array([len(s) for s in sets], np.int64)

    def split(own: np.ndarray) -> list[np.ndarray]:
        """Smaller regions by windows in the exact order of rarity inside this one."""
        flat = np.concatenate([sets[i] for i in own])
        keys, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
        common = count[inverse]
        pivots, names, at = [], [], 0
        for k, i in enumerate(own):
            n = len(sets[i])
            first = np.argsort(common[at : at + n], kind="stable")[: window(n, percent)] + at
            first = first[common[first] > 1]
            pivots.append(inverse[first])
            names.append(np.full(len(first), k))
            at += n
        pivot, name = np.concatenate(pivots), np.concatenate(names)
        # Pivots get numbers of their own beside the sets, and every meeting is an edge.
        nodes, low = smallest_reachable(name, pivot + len(own))
        low = low[nodes < len(own)]
        nodes = nodes[nodes < len(own)]
        order = np.argsort(low, kind="stable")
        cuts = np.flatnonzero(np.diff(low[order])) + 1
        return [own[nodes[part]] for part in np.split(order, cuts) if len(part) > 1]

    reach = 1 - percent / 100

    def shares(pivot: int, rest: np.ndarray) -> np.ndarray:
        """Distances of ``rest`` to a pivot; what is linked with it is joined."""
        n = size_of[rest]
        both = _linked(sets[pivot], np.concatenate([sets[i] for i in rest]), np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        either = n + size_of[pivot] - both
        for x in rest[100 * both >= percent * either]:
            if root[x] != root[pivot]:
                out.append((int(pivot), int(x)))
                a, b = sorted((root[x], root[pivot]))
                root[root == b] = a
        return 1 - both / either

    def outside(open_: np.ndarray) -> np.ndarray:
        """Numbers in ``open_`` of what is not in its largest component, by size of the sets; empty if there is one only."""
        labels, place = np.unique(root[open_], return_inverse=True)
        if len(labels) < 2:
            return np.empty(0, np.int64)
        found = np.flatnonzero(place != np.bincount(place).argmax())
        return found[np.argsort(size_of[open_[found]], kind="stable")]

    def by_cells(own: np.ndarray) -> list[np.ndarray]:
        """Voronoi cells of several pivots with their visitors; none once all is connected."""
        distances, chosen = [], []
        while len(chosen) < PIVOTS:
            choice = outside(own)
            if not len(choice):
                return []
            choice = choice[~np.isin(choice, chosen)]
            if not len(choice):
                break
            chosen.append(choice[len(choice) // 2])
            distances.append(shares(own[chosen[-1]], own))
        cells = [own[c] for c in voronoi_cells(np.array(distances).T, reach)]
        return [c for c in cells if len(c) > 1]

    def one_by_one(open_: np.ndarray) -> None:
        while len(choice := outside(open_)):
            p = choice[len(choice) // 2]
            pivot, rest = open_[p], np.delete(open_, p)
            distance = shares(pivot, rest)
            # Two sets whose distances to the pivot differ by more than the threshold are too far apart, and
            # sets already connected need no comparison.
            order = np.argsort(distance, kind="stable")
            d, r = distance[order], root[rest[order]]
            low = np.searchsorted(d, d - reach - SLACK, side="left")
            high = np.searchsorted(d, d + reach + SLACK, side="right")
            # The window of x holds one component alone iff no change of component lies inside it.
            changes = np.concatenate([[0], np.cumsum(r[1:] != r[:-1])])
            open_ = rest[order[changes[high - 1] != changes[low]]]

    todo = [np.arange(len(sets))[size_of > 0]]
    while todo:
        own = todo.pop()
        if len(own) < 2 or len(np.unique(root[own])) == 1:
            continue
        parts = split(own) if len(own) > 2 else [own]
        if len(parts) == 1 and len(parts[0]) == len(own):
            cells = by_cells(own) if len(own) > SEVERAL else [own]
            if any(len(c) > SHRINK * len(own) for c in cells) or sum(map(len, cells)) > GROW * len(own):
                one_by_one(own)
            else:
                todo += cells
        else:
            todo += parts
    return out


#: Rounding slack of windows; it only lets more through.
SLACK = 1e-9


def voronoi_cells(distance: np.ndarray, reach: float) -> list[np.ndarray]:
    """Rows of each Voronoi cell, with the visitors that links of length ``reach`` may need; the last cell is remote.

    ``distance`` has a row for each document and a column for each pivot.  A document is at home with its nearest
    pivot, or in the remote cell if that is further than ``1 - 2 reach``.  It visits every cell before its own whose
    pivot is at most ``2 reach`` further away than its own one, and at most ``1 - reach`` away at all.  Two
    documents within ``reach`` of each other then are both in the earlier one of their homes.
    """
    remote = 1 - 2 * reach
    nearest = distance.min(axis=1)
    home = np.where(nearest <= remote + SLACK, distance.argmin(axis=1), distance.shape[1])
    window = np.minimum(nearest + 2 * reach, remote + reach) + SLACK
    cells = []
    for k in range(distance.shape[1]):
        cells.append(np.flatnonzero((home == k) | ((home > k) & (distance[:, k] <= window))))
    return [*cells, np.flatnonzero(home == distance.shape[1])]


def _join_pieces(rows: DataFrame, percent: int) -> DataFrame:
    """Links inside each ``piece``; the rows (``piece, doc, known, shingles``) are dealt and sorted by it."""

    def work(batches):
        held: list[tuple[int, int, bytes]] = []
        last = None

        def flush() -> dict:
            unique = {d: (k, s) for d, k, s in held}  # a document may come twice into a piece
            docs = list(unique)
            sets = [np.frombuffer(unique[d][1], np.uint64) for d in docs]
            found = region_links(sets, percent, np.array([unique[d][0] for d in docs]))
            return {"a": [docs[x] for x, _ in found], "b": [docs[y] for _, y in found]}

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512).to_pydict()
                for piece, doc, known, shingles in zip(part["piece"], part["doc"], part["known"], part["shingles"]):
                    if piece != last and held:
                        if len(held) > 1:
                            yield flush()
                        held = []
                    last = piece
                    held.append((doc, known, shingles))
        if len(held) > 1:
            yield flush()

    dealt = rows.repartition("piece").sortWithinPartitions("piece")
    return whole_partition(dealt.select("piece", "doc", "known", "shingles"), work, "a long, b long")


def _distances(rows: DataFrame, large: DataFrame, percent: int, turn: int) -> DataFrame:
    """``piece, doc, n, distance, linked`` of each row of the ``large`` pieces: the distances to the pivots of its
    piece, and those that it is linked with.

    The pivots are PIVOTS documents that a hash chooses in each piece.  A piece is dealt to as many tasks as it has
    blocks, each of which gets its pivots before its rows, so neither pivots nor rows are ever gathered.
    """
    fits = F.when(F.col("n") <= PIVOT_SHINGLES, F.col("doc"))
    chosen = rows.groupBy("piece").agg(
        F.array_distinct(F.array_compact(F.array(*(F.min_by(fits, F.struct(fits.isNull(), F.xxhash64("doc", F.lit(turn * PIVOTS + k)))) for k in range(PIVOTS))))).alias("chosen")
    )
    chosen = stored(chosen.select("piece", F.explode("chosen").alias("doc")), "chosen-pivots")
    pivots = rows.join(broadcast_if_small(chosen), ["piece", "doc"]).dropDuplicates(["piece", "doc"])
    sizes = broadcast_if_small(large.select("piece", "blocks"))
    deal = F.pmod(F.xxhash64("doc", F.lit("deal")), F.col("blocks")).cast("int")
    columns = ["piece", "task", "kind", "doc", "n", "shingles"]
    both = pivots.join(sizes, "piece").withColumn("kind", F.lit(0)).withColumn("task", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = both.select(*columns).union(rows.join(sizes, "piece").withColumn("kind", F.lit(1)).withColumn("task", deal).select(*columns))

    def work(batches):
        last, table = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out = {"piece": [], "doc": [], "n": [], "distance": [], "linked": []}
                part = batch.slice(at, 512).to_pydict()
                for piece, task, kind, doc, n, shingles in zip(*(part[c] for c in columns)):
                    s = np.frombuffer(shingles, np.uint64)
                    if (piece, task) != last:
                        last, table = (piece, task), []
                    if kind == 0:
                        table.append((doc, s))
                        continue
                    both = [len(np.intersect1d(p, s, assume_unique=True)) for _, p in table]
                    either = [len(p) + n - x for (_, p), x in zip(table, both)]
                    near = [d for (d, _), x, y in zip(table, both, either) if d != doc and 100 * x >= percent * y]
                    for k, v in zip(out, (piece, doc, n, [1 - x / y for x, y in zip(both, either)], near)):
                        out[k].append(v)
                yield out

    dealt = both.repartition("piece", "task").sortWithinPartitions("piece", "task", "kind", "doc")
    return whole_partition(dealt, work, "piece string, doc long, n long, distance array<double>, linked array<long>")


def _cell_numbers(reach: float):
    """Column with the numbers of the cells of a row, as :func:`voronoi_cells` defines them."""
    d, remote = F.col("distance"), 1 - 2 * reach
    nearest = F.coalesce(F.array_min(d), F.lit(2.0))
    home = F.when(nearest <= remote + SLACK, F.array_position(d, nearest).cast("int") - 1).otherwise(F.size(d))
    window = F.least(nearest + 2 * reach, F.lit(remote + reach)) + SLACK
    visits = F.transform(d, lambda x, k: F.when((k < home) & (x <= window), k))
    return F.array_compact(F.concat(visits, F.array(home)))


def _shape(rows: DataFrame, region_sets: int, region_shingles: int) -> DataFrame:
    """``piece, sets, blocks`` of every piece; those with one block fit into a task."""
    shape = rows.groupBy("piece").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles"))
    small = (F.col("sets") <= region_sets) & (F.col("shingles") <= region_shingles)
    blocks = F.ceil(F.greatest(F.col("sets") / (region_sets / 2), F.col("shingles") / (region_shingles / 2))).cast("int")
    return shape.select("piece", "sets", F.when(small, 1).otherwise(blocks).alias("blocks"))


def _divide(sets: DataFrame, rows: DataFrame, large: DataFrame, percent: int, region_sets: int, region_shingles: int) -> list[DataFrame]:
    """Links (``a, b``) of pieces that are too large for one task, see steps 3 and 4 above.

    ``sets`` has ``doc, shingles``, ``rows`` has ``piece, doc, n, shingles`` of the large pieces and ``large`` has
    ``piece, sets, blocks``.  Both are stored tables.
    """
    links, turn = [], 0
    block = max(1, region_sets // 2)
    while large.limit(1).count():
        measured = stored(_distances(rows, large, percent, turn), "cell-distances")
        star = stored(measured.select(F.col("doc").alias("a"), F.explode("linked").alias("b")), "pivot-links")
        links.append(star)
        parts = connected_components(star).withColumnRenamed("node", "doc")
        placed = measured.join(parts, "doc", "left").withColumn("known", F.coalesce("component", "doc")).drop("component", "linked")
        placed = stored(placed, "region-parts")
        sizes = placed.groupBy("piece", "known").agg(F.count(F.lit(1)).alias("n"))
        core = sizes.groupBy("piece").agg(
            F.max_by("known", F.struct("n", "known")).alias("core"), F.sum("n").alias("all"), F.max("n").alias("inside"), F.count(F.lit(1)).alias("parts")
        )
        core = stored(core.join(large, "piece"), "region-cores").withColumn("open", F.col("all") - F.col("inside"))
        # Where few documents are outside the core, each block of the region is joined with all of them.
        open_ = core.filter("parts > 1")
        flat = open_.filter(F.col("open") <= block).withColumn("open_blocks", F.lit(1))
        apart = open_.filter(F.col("open") > block)
        cells = placed.join(broadcast_if_small(apart.select("piece", "sets")), "piece")
        cells = cells.withColumn("cell", F.explode(_cell_numbers(1 - percent / 100)))
        cells = cells.select(
            F.concat_ws(".", "piece", "cell").alias("piece"), F.col("piece").alias("above"), "sets", "doc", "n", "known"
        )
        cells = stored(cells, "cells")
        above = cells.groupBy("piece").agg(F.first("above").alias("above"), F.first("sets").alias("whole"))
        shape = stored(_shape(cells, region_sets, region_shingles).join(above, "piece"), "cell-shapes")
        whole_of = shape.groupBy(F.col("above").alias("piece")).agg(
            F.max("sets").alias("largest"), F.sum("sets").alias("total"), F.max("blocks").alias("most"), F.max("whole").alias("whole")
        )
        crowded = (F.col("largest") > SHRINK * F.col("whole")) | (F.col("total") > GROW * F.col("whole"))
        stuck = stored(whole_of.filter((F.col("most") > 1) & crowded).select("piece"), "undivided")
        whole = apart.join(broadcast_if_small(stuck), "piece").withColumn("open_blocks", F.ceil(F.col("open") / block).cast("int"))
        divided = cells.join(broadcast_if_small(stuck.withColumnRenamed("piece", "above")), "above", "left_anti")
        fits = shape.filter("blocks = 1").select("piece")
        pieces = divided.join(broadcast_if_small(fits), "piece").select("piece", "doc", "known")
        pieces = pieces.union(_blocks(placed, flat.unionByName(whole)))
        full = stored(pieces, "pieces").join(sets.select("doc", "shingles"), "doc")
        links.append(stored(_join_pieces(full, percent), "piece-links"))
        large = shape.filter("blocks > 1").join(broadcast_if_small(stuck.withColumnRenamed("piece", "above")), "above", "left_anti")
        large = stored(large.select("piece", "sets", "blocks"), "large-cells")
        rows = divided.join(broadcast_if_small(large.select("piece")), "piece").select("piece", "doc", "n")
        rows = stored(rows.join(sets.select("doc", "shingles"), "doc").select("piece", "doc", "n", "shingles"), "cell-sets")
        turn += 1
    return links


def _blocks(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """``piece, doc, known``: every block of a region with every block of those outside its core."""
    dealt = placed.join(broadcast_if_small(pieces.select("piece", "core", "blocks", "open_blocks")), "piece")
    dealt = dealt.withColumn("all_block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("open_block", F.pmod(F.xxhash64("doc", F.lit(1)), F.col("open_blocks")).cast("int"))
    member = dealt.withColumn("open_block", F.explode(F.sequence(F.lit(0), F.col("open_blocks") - 1)))
    outside = dealt.filter(F.col("known") != F.col("core"))
    outside = outside.withColumn("all_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    name = F.concat_ws("/", "piece", "all_block", "open_block")
    return member.unionByName(outside).select(name.alias("piece"), "doc", "known").distinct()


def similar_documents(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row; the options are those of ``_components``.

    Two documents link if ``100 * intersection >= percent * union`` of their sets of shingles.  The
    component is the smallest id reachable by links, the own id included.  Null texts and texts without
    words have no shingles and link with nothing.  Documents that share an id are one node.  A row
    without an id takes the component of the documents with its set, if any.  An empty table gives no rows;
    other columns are ignored.
    """
    return _components(docs, **options).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _components(
    docs: DataFrame,
    percent: int = 80,
    words: int = 5,
    id_column: str = "doc_id",
    text_column: str = "text",
    region_sets: int = REGION_SETS,
    region_shingles: int = REGION_SHINGLES,
) -> DataFrame:
    """``doc_id, n, h1, h2, text_component, component_id`` of every row.

    The text component is the smallest id that links alone reach from the row's own text; it differs from the
    component only where an id has several texts.
    """
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    first = stored(_sets_and_counts(rows, words), "shingle-sets")
    named = first.filter("kind = 0").select("doc_id", "n", "h1", "h2")
    levels = spark.sparkContext.broadcast(_levels(first.filter("kind = 1").select("shingle", "n")))

    met = stored(_meetings(rows, levels, words, percent), "meetings")
    # Edges are written before they are joined to components: a task then needs one Python worker at a time.
    edges = stored(_meeting_edges(met.filter("kind = 0"), percent), "meeting-edges").union(met.filter("kind = 1").select("a", "b"))
    parts = connected_components(edges).withColumnRenamed("node", "b")
    nodes = met.filter("kind = 2").select(F.col("a").alias("h1"), "b").distinct()
    regions = nodes.join(parts, "b", "left").select("h1", F.coalesce("component", "b").alias("region"))

    classes = named.filter("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("members"))
    classes = stored(classes, "classes")
    placed = stored(classes.join(regions, "h1").filter(F.col("doc").isNotNull()), "class-regions")
    shared = stored(placed.groupBy("region").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("region"), "shared-regions")
    wanted = stored(placed.join(broadcast_if_small(shared), "region").withColumnRenamed("doc", "doc_id"), "region-documents")
    # Few documents are in a region; as long as their ids are few, the texts are filtered without a shuffle.
    sets = stored(_region_sets(rows.join(broadcast_if_small(wanted), "doc_id"), words), "region-sets")

    named_sets = sets.filter("n > 0").withColumn("piece", F.col("region").cast("string"))
    large = stored(_shape(named_sets, region_sets, region_shingles).filter("blocks > 1"), "large-regions")
    small = named_sets.join(broadcast_if_small(large.select("piece")), "piece", "left_anti")
    # Nodes are classes, not ids: an id may have several texts.
    small = small.select("piece", "doc", F.col("doc").alias("known"), "shingles")
    links = [stored(_join_pieces(small, percent), "region-links")]
    if large.limit(1).count():
        rows_of = named_sets.join(broadcast_if_small(large.select("piece")), "piece").select("piece", "doc", "n", "shingles")
        links += _divide(sets, stored(rows_of, "large-region-sets"), large, percent, region_sets, region_shingles)
    links = functools.reduce(DataFrame.union, links)
    parts = stored(connected_components(links), "linked-classes")
    found = classes.join(_smallest_ids(classes, parts, "text_component"), "h1", "left")
    # Ids that several texts share connect their classes.
    torn = named.filter("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("h1").alias("low"), F.max("h1").alias("high"))
    torn = stored(torn.filter("low < high"), "torn-ids")
    if torn.limit(1).count():
        seams = named.filter("n > 0").join(torn, "doc_id").select(F.col("h1").alias("a"), F.col("low").alias("b"))
        parts = stored(connected_components(parts.toDF("a", "b").union(seams)), "joined-classes")
        found = found.join(_smallest_ids(classes, parts, "component_id"), "h1", "left")
    else:
        found = found.withColumn("component_id", F.col("text_component"))
    found = found.select("h1", "h2", "members", "doc", *(F.coalesce(c, "doc").alias(c) for c in ("text_component", "component_id")))
    return _of_rows(named, found)


def _of_rows(named: DataFrame, found: DataFrame) -> DataFrame:
    """The components of the rows, from those of their classes.

    Rows without shingles and rows that are alone in their class and component need none.
    """
    names = ("text_component", "component_id")
    alone = (F.col("members") == 1) & F.col("text_component").eqNullSafe(F.col("doc")) & F.col("component_id").eqNullSafe(F.col("doc"))
    found = stored(found.filter(~alone).drop("doc"), "found-classes")
    joined = join_hot(named.filter("n > 0"), found, ["h1", "h2"], named.count())
    own = (F.when(F.col("members").isNull(), F.col("doc_id")).otherwise(F.col(c)).alias(c) for c in names)
    rest = named.filter("n = 0").select("doc_id", "n", "h1", "h2", *(F.col("doc_id").alias(c) for c in names))
    return joined.select("doc_id", "n", "h1", "h2", *own).union(rest)


def _smallest_ids(classes: DataFrame, parts: DataFrame, name: str) -> DataFrame:
    """``h1`` and the smallest id of its component, of classes that are linked."""
    linked = parts.withColumnRenamed("node", "h1").join(classes.select("h1", "doc"), "h1")
    low = stored(linked.groupBy("component").agg(F.min("doc").alias(name), F.count(F.lit(1)).alias("members")), "smallest-ids")
    return join_hot(parts.withColumnRenamed("node", "h1"), low, ["component"], parts.count()).select("h1", name)


def _region_sets(rows: DataFrame, words: int) -> DataFrame:
    """``region, doc, n, shingles`` of each class that is in a region; ``doc`` is the class's ``h1``."""
    schema = "region long, doc long, n long, shingles binary"

    def make():
        def work(batch):
            out = {"region": [], "doc": [], "n": [], "shingles": []}
            found = shingle_sets(batch["text"], words)
            for s, region, h1, h2 in zip(found, batch["region"], batch["h1"], batch["h2"]):
                if signature(s) == (h1, h2):  # where ids repeat, the row with another text is not meant
                    for k, v in zip(out, (region, h1, len(s), s.tobytes())):
                        out[k].append(v)
            return out

        return work

    return map_rows(rows.select("text", "region", "h1", "h2"), make, schema, rows=64)


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest that links reach from their text; columns unchanged.

    Of rows that repeat such an id all stay; rows without an id stay.  Where an id has several texts, each row
    goes or stays by its own text.
    """
    found = stored(_components(docs, **options), "components")
    gone = F.col("doc_id") != F.col("text_component")
    by_id = found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(gone).alias("some"), F.min(gone).alias("all"))
    by_id = stored(by_id.filter("some"), "near-copies")
    whole = by_id.filter("all").select("doc_id")
    kept = docs.join(broadcast_if_small(whole, 500_000), "doc_id", "left_anti").select(*docs.columns)
    partly = by_id.filter("NOT all").select("doc_id")
    if not partly.limit(1).count():
        return kept
    text = F.col(options.get("text_column", "text")).cast("string")
    rows = docs.join(broadcast_if_small(partly), "doc_id").select("doc_id", text.alias("text")).distinct()
    goes = found.filter(gone).select("doc_id", "h1", "h2").distinct()
    texts = _named_texts(rows, options.get("words", 5)).join(goes, ["doc_id", "h1", "h2"]).select("doc_id", "_digest")
    keyed = kept.withColumn("_digest", F.sha2(text, 256))
    return keyed.join(stored(texts, "copied-texts"), ["doc_id", "_digest"], "left_anti").select(*docs.columns)


def _named_texts(rows: DataFrame, words: int) -> DataFrame:
    """``doc_id, _digest, h1, h2``: the digest of each text and the class of its set."""

    def make():
        def work(batch):
            names = [signature(s) for s in shingle_sets(batch["text"], words)]
            return {"doc_id": batch["doc_id"], "_digest": batch["_digest"], "h1": [x for x, _ in names], "h2": [y for _, y in names]}

        return work

    rows = rows.withColumn("_digest", F.sha2("text", 256))
    return map_rows(rows, make, "doc_id long, _digest string, h1 long, h2 long", rows=64)
