"""Results as chart series: history, long form, points, extents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaygauge.functions.numbers import int_div

# What a dashboard shows.
CHART_OPERATION = "avg10second"
HISTORY_SECONDS = 3600
FIELDS = ("value", "count")


def chart_events(events: DataFrame) -> DataFrame:
    return events.where(F.col("operation") == CHART_OPERATION)


def events_history(events: DataFrame, topic: str, now: int) -> DataFrame:
    """The chart events of one topic in the hour before ``now``, in stored order."""
    recent = (F.col("topic") == topic) & (F.col("second") > F.lit(now) - HISTORY_SECONDS)
    return chart_events(events.where(recent)).orderBy("second", "partition", "consumerid", "eventname")


def series_long(events: DataFrame) -> DataFrame:
    """One row per event and charted field, with the second also as a timestamp."""
    return (
        events.withColumnRenamed("cnt", "count")
        .unpivot(
            ["topic", "partition", "consumerid", "eventname", "second", "operation"], list(FIELDS), "field", "y"
        )
        .withColumn("time", F.timestamp_seconds("second"))
    )


def series_points(events: DataFrame, merge_eventnames: bool = False) -> DataFrame:
    """Ordered points of each line of each topic's chart, one row per line and hour.

    The hour bounds the size of an array.  ``merge_eventnames`` draws all pairs of a partition
    as one line.
    """
    line = ["topic", "consumerid", "field", "partition"] + ([] if merge_eventnames else ["eventname"])
    point = F.struct("second", "eventname", "y")
    return (
        series_long(events)
        .groupBy(*line, (int_div(F.col("second"), HISTORY_SECONDS) * HISTORY_SECONDS).alias("hour"))
        .agg(F.array_sort(F.collect_list(point)).alias("points"))
    )


def series_extent(events: DataFrame) -> DataFrame:
    """Axis bounds of each chart: a chart per topic, consumer and field."""
    return (
        series_long(events)
        .groupBy("topic", "consumerid", "field")
        .agg(
            F.min("second").alias("first_second"),
            F.max("second").alias("last_second"),
            F.min("y").alias("lowest"),
            F.max("y").alias("highest"),
        )
    )
