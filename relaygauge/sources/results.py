"""Latency events as JSON, as a live feed and from the results topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from relaygauge.functions.numbers import int_div
from relaygauge.operators.series import CHART_OPERATION, chart_events
from relaygauge.schemas import EVENT_KEY, LATENCY_EVENT
from relaygauge.sources.records import evaluated_once

# JSON names that differ from column names, and topic names.
JSON_NAMES = {"consumerid": "consumerId", "eventname": "eventName", "cnt": "count"}
RESULT_TOPIC = "%s-latencies"

_REPORT = (StructField("batch", LongType()), StructField("reported", LongType()))


def event_json() -> Column:
    """A latency event as the JSON object a chart page reads."""
    return F.to_json(F.struct(*[F.col(n).alias(JSON_NAMES.get(n, n)) for n in LATENCY_EVENT.names]))


def topic_event_json() -> Column:
    """A latency event under its column names, as the results topic carries it."""
    return F.to_json(F.struct(*LATENCY_EVENT.names))


def report_json(batch: Column) -> Column:
    """As ``topic_event_json`` with the batch that reported the event and the time it did, by which readers tell a
    batch that was run again from a window that was reported again."""
    reported = F.unix_millis(F.current_timestamp()).alias("reported")
    return F.to_json(F.struct(*LATENCY_EVENT.names, batch.cast("bigint").alias("batch"), reported))


def decode_reports(values: DataFrame, value: str = "value") -> DataFrame:
    """Events of a results topic with their batch and the time of the report; other rows are skipped."""
    schema = StructType([*LATENCY_EVENT.fields, *_REPORT])
    events = _whole_rows(values, value, schema)
    return events.withColumn("reported", F.timestamp_millis("reported"))


def reported_once(reports: DataFrame, within: str, tasks: int | None = None) -> DataFrame:
    """Reports without those that a batch sent again when it was run again, up to ``within`` after the first.

    The state of a stream holds the keys of that span of time.  It goes by the time of the report, so a late correction
    of an old window is not late here.  Of bounded reports all repeated ones go.  A task holds the keys it compares in
    memory, so those of a large table are dealt out to as many ``tasks``.
    """
    if not reports.isStreaming:
        if tasks is None:
            return reports.dropDuplicates([*EVENT_KEY, "batch"])
        # The seconds of a minute stay together: rows that differ in little else compress well.
        minutes = reports.withColumn("_minute", int_div(F.col("second"), 60))
        apart = [c for c in (*EVENT_KEY, "batch", "_minute") if c != "second"]
        return minutes.repartition(tasks, *apart).dropDuplicates([*apart, "second"]).drop("_minute")
    return reports.withWatermark("reported", within).dropDuplicatesWithinWatermark([*EVENT_KEY, "batch"])


def decode_events(values: DataFrame, value: str = "value") -> DataFrame:
    """Events of a results topic; rows that are no complete event are skipped."""
    return _whole_rows(values, value, LATENCY_EVENT)


def _whole_rows(values: DataFrame, value: str, schema: StructType) -> DataFrame:
    """JSON values that have all fields, each parsed once however many fields are asked for."""
    parsed = evaluated_once(values, "_event", F.from_json(F.col(value).cast("string"), schema))
    whole = " AND ".join(f"{n} IS NOT NULL" for n in schema.names)
    return parsed.select("_event.*").where(whole)


def live_feed(values: DataFrame, value: str = "value") -> DataFrame:
    """What a live chart shows: decoded events of the charted operation.

    Values that cannot name that operation are not parsed: JSON text has it as it is, or else escapes.
    """
    text = F.col(value).cast("string")
    naming = values.where(F.contains(text, F.lit(CHART_OPERATION)) | F.contains(text, F.lit("\\")))
    return chart_events(decode_events(naming, value))
