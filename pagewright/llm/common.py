"""What the corpus operators share: worker set-up, shared scratch tables, and input guards."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import WRITTEN, drop_all, drop_table, kept, shared_dir, write_table  # noqa: F401 - part of this module's interface
from ..session import prepare as prepare_workers

# The tokenizer library's own thread pool must not compete with Spark's task slots.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Rows of an Arrow batch: bounds what texts a batch holds in the JVM and in Python.
BATCH_ROWS = 2000


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, and keep Arrow batches small enough for long texts."""
    prepare_workers(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


#: ``df`` written to the shared folder and read again with the same schema.
stored = kept


#: Rows of a few narrow columns that may be broadcast.
SMALL = 200_000


def broadcast_if_small(df: DataFrame, most: int | None = None) -> DataFrame:
    """``df`` (a stored table of a few narrow columns) marked for broadcast if it has at most ``most`` rows.

    Beyond that the join shuffles both sides.
    """
    return F.broadcast(df) if is_small(df, most) else df


def is_small(df: DataFrame, most: int | None = None) -> bool:
    """Whether a stored table has at most ``most`` rows, SMALL by default."""
    most = SMALL if most is None else most
    return df.limit(most + 1).count() <= most


#: A key is hot from HOT rows on if it also has more than one of MOST_HOT parts of all rows: so many at most can be hot.
HOT, MOST_HOT = 500, 50_000


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """``left`` joined (left outer) to ``right``, a stored table with one row for each key and its number of ``members``.

    A small ``right`` is broadcast.  Of a larger one the hot keys are broadcast, being at most MOST_HOT, and the rest
    shuffles, so no task gathers a hot key.  ``rows`` is the number of rows of ``left`` that have a key in ``right``
    or more.
    """
    if is_small(right):
        return left.join(F.broadcast(right), keys, "left")
    hot = F.col("members") > max(HOT, rows // MOST_HOT)
    few = right.filter(hot).withColumn("_hot", F.lit(True))
    first = left.join(F.broadcast(few), keys, "left")
    rest = first.filter("_hot IS NULL").select(*left.columns).join(right.filter(~hot), keys, "left")
    return first.filter("_hot").drop("_hot").unionByName(rest)


def filter_rows(df: DataFrame, make: Callable[[], Callable[[list], list[bool]]], column: str, rows: int = 128) -> DataFrame:
    """The rows of ``df`` whose ``column`` passes, all columns as they are.

    ``make()`` runs once for each task and returns the function from a list of values to a list of verdicts.
    """
    at_column = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        passes = make()
        for big in batches:
            for at in range(0, big.num_rows, rows):
                part = big.slice(at, rows)
                yield part.filter(pa.array(passes(part.column(at_column).to_pylist()), pa.bool_()))
        passes = big = part = None
        give_back()

    return df.mapInArrow(run, df.schema)


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text column with null read as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id written as decimal text; splits rows into folds."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def settle() -> None:
    """Fewer searches for cycles during a task: tables of texts have none, and searching them takes long."""
    gc.set_threshold(100_000, 50, 50)


def give_back() -> None:
    """Return freed memory to the system at the end of a task: workers stay, and idle ones must stay small."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_rows(
    df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, object]]], schema: str, rows: int = 512
) -> DataFrame:
    """``mapInArrow`` over small column batches.

    ``make()`` runs once for each task and returns the function that turns a batch, a dict of
    Python lists, into a dict of output columns.  Batches hold at most ``rows`` rows, so memory is
    bounded by ``rows`` texts and not by the partition.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        work = make()
        for big in batches:
            for at in range(0, big.num_rows, rows):
                out = work(big.slice(at, rows).to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)
        work = out = big = None
        give_back()

    return df.mapInArrow(run, schema)


def whole_partition(
    df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, object]]], schema: str
) -> DataFrame:
    """``mapInArrow`` where ``work`` sees the stream of Arrow batches of a task and yields column dicts."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for out in work(batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)
        out = None
        give_back()

    return df.mapInArrow(run, schema)
