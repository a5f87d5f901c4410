"""Best-fit packing of token pieces into sequences of fixed capacity.

Lengths lie between 1 and the capacity, so the whole problem is a histogram of at most ``capacity``
numbers.  It is solved once on the driver by exact complements (single lengths, pairs and triples whose
sums fill the gap of an open sequence exactly, looked up by their value and taken as often as the available
counts allow) and best fit for the rest.  The solution is a list of patterns with multiplicities.  The rows
never leave the executors: each piece gets its rank among the pieces of its length and reads its sequence and
offset from the pattern that owns that rank.
"""

from __future__ import annotations

import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, stored, text_of, whole_partition
from .pretokens import FastIds

#: A pattern: the lengths that share one sequence, and how many sequences look like that.
Pattern = tuple[tuple[int, ...], int]
#: Triples fill gaps once lengths are at most the capacity over this.
TRIPLES = 4


class _Filling:
    """Open sequences by the room left in them, the lengths that wait, and the sums these can make.

    Equal sequences are one group, so the work follows the number of lengths and not that of pieces.
    """

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in histogram.items():
            if not 1 <= length <= capacity:
                raise ValueError(f"a length of {length} does not fit a capacity of {capacity}")
            self.left[length] += n
        self.groups: dict[int, list[Pattern]] = {}

    def rooms(self, least: int) -> list[int]:
        """Rooms that hold this length, the smallest first; an empty sequence if there is none."""
        return sorted(r for r in self.groups if r >= least) or [self.capacity]

    def place(self, room: int, parts: tuple[int, ...]) -> None:
        """Put ``parts`` into as many sequences of this room as their counts allow."""
        need = Counter(parts)
        n = min(int(self.left[x]) // k for x, k in need.items())
        pattern, open_ = self.groups[room].pop() if room in self.groups else ((), n)
        n = min(n, open_)
        for x, k in need.items():
            self.left[x] -= n * k
        for lengths, count, own in ((pattern + parts, n, room - sum(parts)), (pattern, open_ - n, room)):
            if count and lengths:
                self.groups.setdefault(own, []).append((lengths, count))
        if not self.groups.get(room, True):
            del self.groups[room]

    def best(self, length: int) -> tuple[int, tuple[int, ...]]:
        """The smallest room that holds the length, and as many copies as it holds."""
        room = self.rooms(length)[0]
        return room, (length,) * min(room // length, int(self.left[length]))

    def pair(self, total: int, longest: int) -> tuple[int, int] | None:
        """Two waiting lengths up to ``longest`` with this sum, the most even ones."""
        longer = np.arange((total + 1) // 2, min(total - 1, longest) + 1)
        for x in longer[(self.left[longer] > 0) & (self.left[total - longer] > 0)]:
            if 2 * x != total or self.left[x] > 1:
                return int(x), int(total - x)
        return None

    def exact(self, length: int) -> tuple[int, tuple[int, ...]] | None:
        """A room and one, two or three waiting lengths that fill it, ``length`` being the longest of them."""
        rooms = self.rooms(length)
        if length in self.groups:
            return length, (length,)
        for room in reversed(rooms):
            rest = room - length
            if 0 < rest <= length and self.left[rest] > (rest == length):
                return room, (length, rest)
        if length > self.capacity // TRIPLES:
            return None
        self.left[length] -= 1  # it is taken, so the pair may not use it again
        found = ((room, self.pair(room - length, length)) for room in reversed(rooms) if room - length > 1)
        room, two = next((f for f in found if f[1]), (0, None))
        self.left[length] += 1
        return (room, (length, *two)) if two else None


def plan_packing(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that hold every length of ``histogram`` exactly as often as it occurs.

    Lengths are taken from the longest to the shortest.  As long as some open room is the sum of the length and
    at most two that wait, it is filled exactly, as often as the counts allow: a single length first, then a
    pair, then a triple.  What has no exact complement goes where it fits best.  Triples begin at a quarter of
    the capacity: earlier they would use up small lengths that longer ones need.
    """
    state = _Filling(histogram, capacity)
    for length in range(capacity, 0, -1):
        while state.left[length]:
            state.place(*(state.exact(length) or state.best(length)))
    return [p for own in state.groups.values() for p in own]


def _ranges(plan: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset) of every slot of every pattern."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for lengths, n in plan:
        offset = 0
        for length in lengths:
            at = used.get(length, 0)
            out.append((length, at, at + n, sequence, offset))
            used[length] = at + n
            offset += length
        sequence += n
    return out


def assign_sequences(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Give every piece its sequence and offset.

    ``pieces`` is a stored table with ``length int``, ``task int`` and ``nth long``: the piece is the
    nth of its length (from 0) in that task.  The ranks of a length are made from the counts of
    (length, task), so a length that holds a third of all rows is never gathered anywhere.  The
    broadcast table has a row for each slot of each pattern; lengths bound their number, not rows.
    """
    spark: SparkSession = pieces.sparkSession
    counts = stored(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ranges = np.array(_ranges(plan_packing(histogram, capacity)), np.int64).reshape(-1, 5)
    # An Arrow table comes to the JVM as it is; a list of rows would start Python workers of its own.
    slots = spark.createDataFrame(pa.table(dict(zip(("r_length", "r_from", "r_to", "r_sequence", "r_offset"), ranges.T))))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["length", "task"]).withColumn("rank", F.col("base") + F.col("nth"))
    return (
        ranked.join(
            F.broadcast(slots),
            (F.col("length") == F.col("r_length")) & (F.col("rank") >= F.col("r_from")) & (F.col("rank") < F.col("r_to")),
        )
        .withColumn("sequence_id", F.col("r_sequence") + F.col("rank") - F.col("r_from"))
        .withColumnRenamed("r_offset", "offset")
        .drop("base", "rank", "r_length", "r_from", "r_to", "r_sequence")
    )


@lru_cache(maxsize=1)
def _ids(path: str) -> FastIds:
    return FastIds(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; all but the first are ``capacity`` long."""
    first = n % capacity or capacity
    if n <= capacity:
        return [(0, n)]
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def token_pieces(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    capacity: int = 1024,
    end_id: int = 2,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Tokenised documents, cut where longer than ``capacity``.

    Columns ``doc_id, piece, start, length, ids_crc32, task, nth`` and, if asked for, ``ids`` (little-endian
    unsigned 32-bit).  Null text is empty, so its only token is ``end_id``.
    """
    prepare(docs.sparkSession)
    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    end = end_id.to_bytes(4, "little")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", *(["ids"] if with_ids else [])]

    def work(batches):
        encoder = _ids(path)
        task, seen = TaskContext.get().partitionId(), {}
        for big in batches:
            for at in range(0, big.num_rows, 256):
                part = big.slice(at, 256).to_pydict()
                out: dict[str, list] = {k: [] for k in names}
                for doc, text in zip(part["doc_id"], part["text"]):
                    data = encoder.ids(text).tobytes() + end
                    for k, (start, length) in enumerate(cut(len(data) // 4, capacity)):
                        own = data[4 * start : 4 * (start + length)]
                        nth = seen.get(length, 0)
                        seen[length] = nth + 1
                        for name, x in zip(names, (doc, k, start, length, zlib.crc32(own), task, nth, own)):
                            out[name].append(x)
                yield out

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(docs, text_column).alias("text"))
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, nth long"
    return whole_partition(rows, work, schema + (", ids binary" if with_ids else ""))


def pack_documents(docs: DataFrame, capacity: int = 1024, **options) -> DataFrame:
    """Pack all ``docs`` into sequences of at most ``capacity`` tokens.

    One row for each piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``
    with ``with_ids=True``).  In a sequence the pieces lie gapless from offset 0.  Null or empty text is
    the end token alone; repeated rows are packed each for itself; an empty table gives no rows; other
    columns of ``docs`` are ignored.
    """
    pieces = stored(token_pieces(docs, capacity=capacity, **options), "packing-pieces")
    packed = assign_sequences(pieces, capacity)
    more = ["ids"] if "ids" in pieces.columns else []
    return packed.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset", *more
    )
