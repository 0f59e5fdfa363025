"""Paced replay: a stored dataset released again in the order of a column, at a speed of its own."""

from __future__ import annotations

from collections.abc import Callable
from threading import Event

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from relaygauge.sinks.topics import write_topic


class Replay:
    """A running replay.  ``wait`` returns when all rows have been released, and ends the query."""

    def __init__(self, query: StreamingQuery, done: Event) -> None:
        self.query, self._done = query, done

    def wait(self, seconds: float | None = None) -> bool:
        """Whether all rows were released within ``seconds``; an error of the query is raised here."""
        while not self._done.wait(0.2):
            if not self.query.isActive:
                self.query.awaitTermination()
                return False
            if seconds is not None:
                seconds -= 0.2
                if seconds <= 0:
                    return False
        self.query.stop()
        return True


def by_time(column: str) -> Column:
    """Microseconds of a timestamp, to replay rows with the gaps they had: a million of them are a second."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def replay_stream(
    rows: DataFrame,
    order: Column,
    per_second: int,
    release: Callable[[DataFrame, int], None],
    checkpoint: str,
    interval_ms: int = 1000,
    first: int | None = None,
) -> Replay:
    """Release ``rows`` by a whole-number ``order``, ``per_second`` units of it a second.

    ``release`` gets the rows of each interval and its number.  With ``by_time`` and 1,000,000 a second the rows come with
    the gaps they had, exact to the interval; with a running number as order they come at a rate.  Each interval is a
    bound on the scan, so a dataset that is stored in this order is read once in all.

    Intervals are counted by batches, not by the clock: a replay that is started again from its
    ``checkpoint`` goes on with the interval that it was in, whatever time has passed, and an interval that
    is released again has the same rows and number.  ``first`` is where the order begins, its least value by
    default; rows below it are not released.
    """
    if per_second < 1 or interval_ms < 1:
        raise ValueError("a replay goes forward")
    step = max(1, per_second * interval_ms // 1000)
    placed = rows.select("*", order.cast("bigint").alias("_order"))
    low, high = placed.agg(F.min("_order"), F.max("_order")).first()
    start = low if first is None else first
    done = Event()

    def interval(batch: DataFrame, _: int) -> None:
        # A row per batch and no other: the number of the interval.
        for tick in batch.select("value").collect():
            begin = None if start is None else start + tick["value"] * step
            if begin is None or high is None or begin > high:
                done.set()
                return
            within = (F.col("_order") >= begin) & (F.col("_order") < begin + step)
            release(placed.where(within).drop("_order"), tick["value"])

    ticks = (
        rows.sparkSession.readStream.format("rate-micro-batch")
        .option("rowsPerBatch", 1)
        .option("numPartitions", 1)
        .option("advanceMillisPerBatch", interval_ms)
        .load()
    )
    query = (
        ticks.writeStream.foreachBatch(interval)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=f"{interval_ms} milliseconds")
        .start()
    )
    return Replay(query, done)


def replay_to_topic(
    rows: DataFrame, order: Column, per_second: int, checkpoint: str, interval_ms: int = 1000, **sink: str
) -> Replay:
    """Release topic rows to a topic; ``sink`` holds arguments for ``write_topic``.  A row comes at least once."""
    return replay_stream(rows, order, per_second, lambda some, _: write_topic(some, **sink), checkpoint, interval_ms)
