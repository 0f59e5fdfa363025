"""The latency job: records to one-second buckets, buckets to rolling averages.

Each window is reported once, when it has ended, and again only when a late record changes it; nothing is
dropped, however late it comes.  For each series the job keeps a frontier: windows that end up to there
have been reported.  Each batch stores what its records add to the buckets of their seconds, moves the
frontiers on, and reports the windows they pass, from the stored buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from relaygauge.functions.keys import window_seconds
from relaygauge.functions.numbers import int_div
from relaygauge.operators.latencies import latency_buckets
from relaygauge.operators.rolling import WINDOWS, counted_spans, newest_spans, rolling_spans, unfold_spans
from relaygauge.schemas import BUCKET, EVENT_KEY, LATENCY_SPAN, SERIES_KEY
from relaygauge.sinks.files import Files
from relaygauge.sinks.levels import LevelledTable, summed_by
from relaygauge.sinks.tables import BATCH
from relaygauge.sinks.topics import event_values, write_topic
from relaygauge.streaming import LATENCY_INTERVAL

# Seconds by which stored buckets are looked up.
STRETCH = 900
# Seconds that a series may lag behind the newest one before its windows are taken to have ended.
LAG = 60

# Rows of a file that a batch writes, at most about.
FILE_ROWS = 500_000

_FRONTIER = StructType(
    [*[f for f in BUCKET.fields if f.name in SERIES_KEY], *[StructField(c, LongType()) for c in ("ended", "newest")]]
)


def buckets_table(spark: SparkSession, root: str) -> LevelledTable:
    """One-second buckets; a second has a row per batch that has added to it, until they merge."""
    keys = [*SERIES_KEY, "second"]
    combine = summed_by(keys, ["total", "cnt"])
    return LevelledTable(spark, f"{root}/buckets", BUCKET, combine, ("second", *SERIES_KEY), "second")


def events_table(spark: SparkSession, root: str) -> LevelledTable:
    """Reported windows as spans of seconds; a window that was reported again replaces the earlier report."""
    order = tuple("from" if c == "second" else c for c in EVENT_KEY)
    return LevelledTable(spark, f"{root}/events", LATENCY_SPAN, lambda rows: newest_spans(rows, BATCH), order)


def clock_ticks(spark: SparkSession) -> DataFrame:
    """A stream of a tick a second, to end the windows of series that have fallen silent."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.select(F.col("timestamp").alias("arrived_at"))


def latency_stream(
    records: DataFrame,
    root: str,
    checkpoint: str,
    windows: Sequence[tuple[str, int]] = WINDOWS,
    trigger: dict = LATENCY_INTERVAL,
    results: dict | None = None,
    files: int = 1,
    lag: int = LAG,
    clock: DataFrame | None = None,
) -> StreamingQuery:
    """Run the latency job on a stream of records; ``root`` belongs to one ``checkpoint``.

    Events go to the table below ``root`` and, if ``results`` holds arguments for
    ``write_topic`` and the topic's name, to the results topic as well.  A window has ended when its series
    has a record of its last second or a later one, or any series has one ``lag`` seconds later, or a
    row of ``clock`` is that late.  A batch that is run again gives the same rows once.  A batch writes ``files``
    files per table, more where it has many rows.  ``close_windows`` reports what a run that ends has left open.
    """
    if clock is not None:
        records = records.unionByName(clock, allowMissingColumns=True)

    def report(batch: DataFrame, batch_id: int) -> None:
        parts = latency_buckets(batch).persist()
        try:
            # One row: where the batch's buckets lie, and the newest second of all its rows.
            span = parts.agg(
                F.min("second").alias("low"), F.max("second").alias("high"), F.count(F.lit(1)).alias("count")
            ).first()
            newest = batch.agg(F.max(F.unix_seconds("arrived_at"))).first()[0]
            _report(parts, batch_id, span, newest, root, windows, results, files, lag)
        finally:
            parts.unpersist()

    return (
        records.writeStream.foreachBatch(report)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def close_windows(
    spark: SparkSession, root: str, windows: Sequence[tuple[str, int]] = WINDOWS, results: dict | None = None, files: int = 1
) -> None:
    """Report the windows that a run which has ended left open.  The stream may go on from its checkpoint."""
    stored = _snapshots(spark, root)
    if stored:
        nothing = spark.createDataFrame([], BUCKET)
        span = Row(low=None, high=None, count=0)
        _report(nothing, max(stored) // 2, span, None, root, windows, results, files, 0, closing=True)


def _snapshots(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n) for n in Files(spark, root).names(f"{root}/frontier") if n.isdigit())


def _report(
    parts: DataFrame,
    batch_id: int,
    span: Row,
    newest: int | None,
    root: str,
    windows: Sequence[tuple[str, int]],
    results: dict | None,
    files: int,
    lag: int,
    closing: bool = False,
) -> None:
    spark = parts.sparkSession
    # Batches have even numbers in the tables; closing after one has the odd number that follows.
    version = 2 * batch_id + closing
    longest = max(window_seconds(unit, length) for unit, length in windows)
    buckets, events = buckets_table(spark, root), events_table(spark, root)
    low, high = span["low"], span["high"]
    if low is not None:
        buckets.append(parts, version, max(files, -(-span["count"] // FILE_ROWS)), merge_below=None)

    before = [v for v in _snapshots(spark, root) if v < version]
    known = (
        spark.read.schema(_FRONTIER).parquet(f"{root}/frontier/{before[-1]}")
        if before
        else spark.createDataFrame([], _FRONTIER)
    )
    # The row without a series is the clock.
    clock = F.max(F.when(F.col("topic").isNull(), F.col("newest"))).alias("clock")
    own = F.col("topic").isNotNull()
    was = known.agg(
        clock, F.min("ended").alias("ended"), F.max(F.when(own, F.col("newest"))).alias("newest"), F.count_if(own).alias("series")
    ).first()
    now = max((t for t in (was["clock"], newest) if t is not None), default=None)
    frontiers = _moved(parts, known.where("topic IS NOT NULL"), now, longest, lag, closing)

    wide = _looked_up(spark, parts, low, high, was["ended"], was["newest"], longest)
    if wide is not None:
        first, last, stretches = wide
        stored = buckets.versions(first, last, until=version).drop("batch_id").withColumn("fresh", F.lit(0).cast("bigint"))
        fresh = parts.select(*SERIES_KEY, "second", *[F.lit(0).cast("bigint").alias(c) for c in ("total", "cnt")], F.lit(1).cast("bigint").alias("fresh"))
        near = stored.unionByName(fresh).withColumn("stretch", int_div(F.col("second"), STRETCH)).join(stretches, "stretch", "left_semi")
        summed = near.groupBy(*SERIES_KEY, "second").agg(*[F.sum(c).alias(c) for c in ("total", "cnt")], F.max("fresh").alias("fresh"))
        reported = _ended(summed.join(frontiers, SERIES_KEY), windows)
        # A bucket begins and ends a span per window: large batches go to more files.
        most = 2 * (span["count"] + was["series"]) * len(windows)
        _write_events(reported, events, version, results, max(files, -(-most // FILE_ROWS)))

    # Series whose last window has been reported need no frontier any more.
    live = frontiers.where(F.col("ended") < F.col("newest") + longest).select(*_FRONTIER.names)
    tick = spark.createDataFrame([(*[None] * len(SERIES_KEY), None, now)], _FRONTIER)
    live.unionByName(tick).repartition(files).write.mode("overwrite").parquet(f"{root}/frontier/{version}")
    keeper = Files(spark, root)
    for old in before[:-2]:
        keeper.remove(f"{root}/frontier/{old}")
    buckets.merge(buckets.file_bytes)
    events.merge(events.file_bytes)


def _moved(parts: DataFrame, known: DataFrame, now: int | None, longest: int, lag: int, closing: bool) -> DataFrame:
    """Frontiers after a batch: ``ended`` up to which windows are to be reported, ``passed`` up to which they were.

    A series that has none is new or long reported; its windows are those of its records now.
    """
    own = parts.groupBy(*SERIES_KEY).agg(F.max("second").alias("_second"))
    met = known.join(own, SERIES_KEY, "full")
    newest = F.greatest("newest", "_second")
    behind = F.lit(None if now is None else now - lag).cast("bigint")
    ended: Column = newest + longest if closing else F.greatest("ended", "_second", behind)
    # Beyond the last window there is nothing to report.
    ended = F.greatest("ended", F.least(ended, newest + longest))
    return met.select(*SERIES_KEY, F.coalesce("ended", ended).alias("passed"), ended.alias("ended"), newest.alias("newest"))


def _looked_up(
    spark: SparkSession, parts: DataFrame, low: int | None, high: int | None, passed: int | None, newest: int | None, longest: int
) -> tuple[int, int, DataFrame] | None:
    """The range and the stretches of seconds whose buckets lie in a window to report, None if there are none.

    Those are the ones around the batch's buckets, and those from the frontier that is furthest behind to
    the newest bucket of a series that has one.
    """
    ranges = []
    if low is not None:
        own = parts.select(int_div(F.col("second"), STRETCH).alias("own")).distinct()
        reach = -(-longest // STRETCH)
        around = F.sequence(F.col("own") - reach, F.col("own") + reach)
        ranges.append((low - longest, high + longest, own.select(F.explode(around).alias("stretch"))))
    if passed is not None:
        first = passed - longest
        ranges.append((first, newest, spark.range(first // STRETCH, newest // STRETCH + 1).select(F.col("id").alias("stretch"))))
    if not ranges:
        return None
    stretches = ranges[0][2] if len(ranges) == 1 else ranges[0][2].union(ranges[1][2])
    return min(r[0] for r in ranges), max(r[1] for r in ranges), stretches.distinct()


def _ended(buckets: DataFrame, windows: Sequence[tuple[str, int]]) -> DataFrame:
    """Spans of windows that end after ``passed`` and up to ``ended``, and of earlier ones that hold a fresh bucket."""
    spans = rolling_spans(buckets, windows, sums=["fresh"], keep=["passed", "ended"])
    touched = F.col("fresh") > 0
    start = F.when(touched, F.col("from")).otherwise(F.greatest("from", F.col("passed") + 1))
    end = F.least(F.col("until") - 1, F.col("ended"))
    return spans.where(start <= end).select(
        *SERIES_KEY, "operation", start.alias("from"), (end + 1).alias("until"), "value", "cnt"
    )


def _write_events(spans: DataFrame, table: LevelledTable, version: int, results: dict | None, files: int) -> None:
    if results is None:
        table.append(spans, version, files, merge_below=None)
        return
    spans.persist()
    try:
        table.append(spans, version, files, merge_below=None)
        sink = dict(results)
        write_topic(event_values(unfold_spans(spans), sink.pop("topic"), version), **sink)
    finally:
        spans.unpersist()


def read_buckets(spark: SparkSession, root: str) -> DataFrame:
    """All buckets the job has stored, the parts of each added up."""
    return buckets_table(spark, root).current()


def read_events(spark: SparkSession, root: str) -> DataFrame:
    """The events table: one row per event key, the one reported last."""
    return unfold_spans(events_table(spark, root).current())


def read_reports(spark: SparkSession, root: str) -> DataFrame:
    """Every report of a window that is still stored as such, with the number of its batch."""
    return unfold_spans(events_table(spark, root).versions(), keep=[BATCH])


def read_report_counts(spark: SparkSession, root: str) -> DataFrame:
    """Events that are still stored as reported, with how often: ``reports`` with the same value and count."""
    return unfold_spans(counted_spans(events_table(spark, root).versions(), "reports"), keep=["reports"])
