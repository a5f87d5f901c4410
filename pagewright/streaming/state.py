"""Stateful operators on events: the circuit breaker and the spacing of calls, as a stream and as batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def breaker_stream(events: DataFrame, cooldown_seconds: int = 1800) -> DataFrame:
    """Gate calls of each ``key``: ``key, at, failed`` to ``key, at, skipped``.

    A failed call that is not skipped opens the breaker for the cooldown.  Events are taken in order of time
    within a batch; state is one time for each key and is dropped when its cooldown is over.
    """

    def gate(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        until = state.get[0] if state.exists else float("-inf")
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        skipped = []
        for at, failed in zip(rows["at"], rows["failed"]):
            now = at.timestamp()
            skipped.append(now < until)
            if failed and now >= until:
                until = now + cooldown_seconds
        if until > float("-inf"):
            state.update((until,))
            state.setTimeoutTimestamp(max(int(until * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": key[0], "at": rows["at"], "skipped": skipped})

    return events.groupBy("key").applyInPandasWithState(
        gate, "key string, at timestamp, skipped boolean", "until double", "append", GroupStateTimeout.EventTimeTimeout
    )


def breaker_batch(events: DataFrame, key: str, at: str, order: str, failed, cooldown_seconds: int = 1800) -> DataFrame:
    """The same gate over a finished table.  Adds ``skipped``.

    Only failures change the state.  A failure that comes the cooldown or more after the one before it finds
    the breaker closed, so the failures of a key fall into spells that do not depend on each other; each spell is a
    sorted stream through one task, which keeps one time.  Every event then looks up the last failure that opened
    the breaker before it.
    """
    cooldown = cooldown_seconds * 1_000_000
    marked = events.withColumn("_t", F.unix_micros(F.col(at).cast("timestamp"))).withColumn("_failed", failed)
    in_time = Window.partitionBy(key).orderBy("_t", order)
    before = F.lag("_t").over(in_time)
    slim = marked.filter("_failed").select(key, order, "_t").withColumn("_new", F.when(F.col("_t") - before < cooldown, 0).otherwise(1))
    spells = slim.withColumn("_spell", F.sum("_new").over(in_time.rowsBetween(Window.unboundedPreceding, 0)))

    def open_(batches):
        last, until = None, 0
        for batch in batches:
            keep = []
            for k, spell, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (k, spell) != last:
                    last, until = (k, spell), t
                keep.append(t >= until)
                if t >= until:
                    until = t + cooldown
            yield batch.filter(pa.array(keep, pa.bool_()))

    stream = spells.select(key, "_spell", "_t", order).repartition(key, "_spell").sortWithinPartitions(key, "_spell", "_t", order)
    trips = stream.mapInArrow(open_, stream.schema).select(key, order, F.lit(True).alias("_trip"))
    w = in_time.rowsBetween(Window.unboundedPreceding, -1)
    joined = marked.join(trips, [key, order], "left")
    last = F.max(F.when(F.col("_trip"), F.col("_t"))).over(w)
    return joined.withColumn("skipped", F.coalesce(F.col("_t") < last + cooldown, F.lit(False))).drop("_t", "_failed", "_trip")


def spaced_calls(calls: DataFrame, keys: list[str], at: str, order: str, per_minute: int = 5) -> DataFrame:
    """Start of each call if calls of a group must lie 60 / per_minute seconds apart: ``start_us``.

    start(n) = max(at(n), start(n - 1) + gap), which is gap * n + max over k <= n of (at(k) - gap * k): one
    running maximum instead of a fold.
    """
    gap = 60_000_000 // max(per_minute, 1)
    w = Window.partitionBy(*keys).orderBy("_t", order)
    rows = calls.withColumn("_t", F.unix_micros(F.col(at).cast("timestamp")))
    numbered = rows.withColumn("_n", F.row_number().over(w).cast("long") * gap)
    start = F.max(F.col("_t") - F.col("_n")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_n")
    return numbered.withColumn("start_us", start).withColumn("wait_us", F.col("start_us") - F.col("_t")).drop("_t", "_n")
