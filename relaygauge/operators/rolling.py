"""Rolling averages over one-second buckets, for any number of windows in one pass.

A bucket of second b lies in the windows ending at b+1 ... b+D.  It enters the running sum at
b+1 and leaves it at b+D+1, so a series needs two changes per bucket instead of D copies.
Time is cut into blocks, and a bucket enters each block it can be seen from; no task handles
more of a series than one block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relaygauge.functions.keys import average_label, window_seconds
from relaygauge.functions.numbers import int_div
from relaygauge.schemas import LATENCY_EVENT, SERIES_KEY

# The windows a latency job reports.
WINDOWS = (("second", 10), ("second", 30), ("minute", 1), ("minute", 5), ("minute", 10), ("minute", 15))

BLOCK_SECONDS = 6 * 3600


def _emissions(first: Column, end: Column, every: int) -> Column:
    """Multiples of ``every`` in [first, end); at least one must exist."""
    start = int_div(first + (every - 1), every) * every
    return F.sequence(start, end - 1, F.lit(every).cast("bigint"))


def rolling_spans(
    buckets: DataFrame,
    windows: Sequence[tuple[str, int]] = WINDOWS,
    block_seconds: int = BLOCK_SECONDS,
    sums: Sequence[str] = (),
    keep: Sequence[str] = (),
) -> DataFrame:
    """(series, operation, from, until, value, cnt): all non-empty windows without loss, those that
    end at consecutive seconds over the same buckets as one row.

    A bucket starts and ends at most one row per window, however long that is; rows are cut at
    blocks of time.  ``sums`` are further columns of the buckets to add up per window, ``keep`` columns that
    a series has the same in all its buckets.
    """
    spans = [(average_label(unit, n), window_seconds(unit, n)) for unit, n in windows]
    if block_seconds < max(span for _, span in spans):
        raise ValueError("a block is at least as long as the longest window")

    # Shuffled as they are, a row per bucket and block it is seen from; windows and changes
    # unfold where the series of a block lies.
    longest = max(span for _, span in spans)
    enter = F.col("second") + 1
    reach = F.sequence(int_div(enter, block_seconds), int_div(enter + longest - 1, block_seconds))
    placed = buckets.select("*", F.explode(reach).alias("block")).repartition(*SERIES_KEY, "block")
    # Windows go by number and get their names at the end.  A group's hash comes first where rows are sorted, as
    # most comparisons end there; the columns behind it tell groups apart.
    operations = F.array(*[F.lit(o) for o, _ in spans])
    span_rows = F.array(
        *[F.struct(F.lit(i).alias("_window"), F.lit(s).cast("bigint").alias("span")) for i, (_, s) in enumerate(spans)]
    )
    leave = enter + F.col("span")
    start = F.col("block") * block_seconds
    end = start + block_seconds
    added = ["total", "cnt", *sums]
    changes = F.array(
        F.struct(F.greatest(enter, start).alias("at"), *[F.col(c).alias(f"d_{c}") for c in added]),
        F.struct(leave.alias("at"), *[(-F.col(c)).alias(f"d_{c}") for c in added]),
    )
    seen = placed.select("*", F.inline(span_rows)).where((enter < end) & (leave > start))
    group = F.xxhash64(*SERIES_KEY, "block", "_window").alias("_group")
    changed = seen.select(*SERIES_KEY, *keep, group, "_window", "block", F.inline(changes)).where(F.col("at") < end)

    series = W.partitionBy("_group", "_window", "block", *SERIES_KEY).orderBy("at")
    upto = series.rangeBetween(W.unboundedPreceding, W.currentRow)
    states = changed.select(
        *SERIES_KEY,
        *keep,
        "_window",
        "at",
        F.coalesce(F.lead("at").over(series), end).alias("until"),
        *[F.sum(f"d_{c}").over(upto).alias(c) for c in added],
    )
    # Changes at one instant all see its final state; only the last of them spans time.
    return states.where((F.col("cnt") > 0) & (F.col("at") < F.col("until"))).select(
        *SERIES_KEY,
        F.get(operations, F.col("_window")).alias("operation"),
        F.col("at").alias("from"),
        "until",
        int_div(F.col("total"), F.col("cnt")).alias("value"),
        "cnt",
        *sums,
        *keep,
    )


def rolling_averages(
    buckets: DataFrame,
    windows: Sequence[tuple[str, int]] = WINDOWS,
    emit_every: int = 1,
    block_seconds: int = BLOCK_SECONDS,
) -> DataFrame:
    """Latency events: the truncated average and count of each non-empty window.

    ``second`` is the end of the window; windows end at multiples of ``emit_every``.
    """
    if emit_every < 1:
        raise ValueError("emit_every is at least one second")
    return unfold_spans(rolling_spans(buckets, windows, block_seconds), emit_every)


def unfold_spans(spans: DataFrame, emit_every: int = 1, keep: Sequence[str] = ()) -> DataFrame:
    """Spans as latency events, one per second, with further columns to ``keep``."""
    first_emission = int_div(F.col("from") + (emit_every - 1), emit_every) * emit_every
    return (
        spans.where(first_emission < F.col("until"))
        .select(
            *SERIES_KEY,
            F.explode(_emissions(F.col("from"), F.col("until"), emit_every)).alias("second"),
            "operation",
            "value",
            "cnt",
            *keep,
        )
        .select(*LATENCY_EVENT.names, *keep)
    )


def newest_spans(spans: DataFrame, version: str) -> DataFrame:
    """Spans that hold, of all versions of a window, the one of the highest ``version``."""
    newest = _merged_spans(spans, [*SERIES_KEY, "operation"], F.struct(version, "value", "cnt"), F.max)
    return newest.select(*[F.col("_merged")[c].alias(c) if c in ("value", "cnt", version) else c for c in spans.columns])


def counted_spans(spans: DataFrame, name: str) -> DataFrame:
    """Spans with the number of times that each window is there with the same value and count, as column ``name``."""
    keys = [*SERIES_KEY, "operation", "value", "cnt"]
    return _merged_spans(spans, keys, F.lit(1).cast("bigint"), F.sum).withColumnRenamed("_merged", name)


def _merged_spans(spans: DataFrame, keys: Sequence[str], column: Column, merge: Callable[[Column], Column]) -> DataFrame:
    """(keys, from, until, _merged): ``column`` merged for each second that spans of a key have in common.

    Spans cross the shuffle as they are.  Equal ones meet as such, ones that touch no other stay, and only those
    that cross another are cut into seconds, so the result has a row per span where versions agree about the bounds.
    """
    block = F.sequence(int_div(F.col("from"), BLOCK_SECONDS), int_div(F.col("until") - 1, BLOCK_SECONDS))
    start = F.col("block") * BLOCK_SECONDS
    place = [*keys, "block"]
    cut = (
        spans.select(*keys, "from", "until", column.alias("_merged"), F.explode(block).alias("block"))
        .withColumns({"from": F.greatest("from", start), "until": F.least("until", start + BLOCK_SECONDS)})
        .repartition(*place)
    )
    apart = cut.groupBy(*place, "from", "until").agg(merge("_merged").alias("_merged"))
    line = W.partitionBy(*place).orderBy("from", "until")
    before = F.max("until").over(line.rowsBetween(W.unboundedPreceding, -1))
    crossed = F.coalesce(before > F.col("from"), F.lit(False)) | F.coalesce(F.lead("from").over(line) < F.col("until"), F.lit(False))
    step = F.when(F.col("crossed"), F.lit(1).cast("bigint")).otherwise(F.col("until") - F.col("from"))
    pieces = (
        apart.select("*", crossed.alias("crossed"))
        .select(*place, "_merged", step.alias("step"), F.explode(F.sequence(F.col("from"), F.col("until") - 1, step)).alias("from"))
        .withColumn("until", F.col("from") + F.col("step"))
    )
    return pieces.groupBy(*place, "from", "until").agg(merge("_merged").alias("_merged")).drop("block")


def native_rolling_averages(buckets: DataFrame, unit: str, length: int, tasks: int | None = None) -> DataFrame:
    """The same by Spark's own sliding window, for short windows: each bucket is copied into
    every window it lies in.  Works on streams.

    A task holds all windows that it adds up in memory, so those of a large table are dealt out to as many ``tasks``.
    """
    span = window_seconds(unit, length)
    sliding = F.window(F.timestamp_seconds("second"), f"{span} seconds", "1 second")
    copies = buckets.select(*SERIES_KEY, sliding.alias("window"), "total", "cnt")
    if tasks is not None:
        copies = copies.repartition(tasks, *SERIES_KEY, "window")
    return (
        copies.groupBy(*SERIES_KEY, "window")
        .agg(F.sum("total").alias("total"), F.sum("cnt").alias("cnt"))
        .select(
            *SERIES_KEY,
            F.unix_seconds("window.end").alias("second"),
            F.lit(average_label(unit, length)).alias("operation"),
            int_div(F.col("total"), F.col("cnt")).alias("value"),
            "cnt",
        )
    )
