"""Topic output: plain lines, framed records, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaygauge.functions.frames import build_frame
from relaygauge.functions.text import utf8_bytes
from relaygauge.sources.results import RESULT_TOPIC, report_json, topic_event_json
from relaygauge.sources.topics import BROKER_FORMAT


def line_values(lines: DataFrame, topic: str) -> DataFrame:
    """Lines as unkeyed topic values."""
    return lines.select(F.lit(topic).alias("topic"), utf8_bytes(F.col("line")).alias("value"))


def framed_values(records: DataFrame, topic: str, schema_id: int, body: Column) -> DataFrame:
    """Records as framed topic values; ``body`` encodes one (``to_json`` bytes, ``to_avro``)."""
    return records.select(F.lit(topic).alias("topic"), build_frame(F.lit(schema_id), body).alias("value"))


def event_values(events: DataFrame, topic: str, batch: int | None = None) -> DataFrame:
    """Latency events as values of the results topic of ``topic``, with the ``batch`` that reports them if given."""
    json = topic_event_json() if batch is None else report_json(F.lit(batch))
    # What JSON is written is UTF-8 as it stands; encoding it would decode it first.
    return events.select(F.lit(RESULT_TOPIC % topic).alias("topic"), json.cast("binary").alias("value"))


def write_topic(values: DataFrame, sink_format: str = BROKER_FORMAT, path: str | None = None, **options: str) -> None:
    """Append (topic, value) rows to a broker or, under the same columns, to files."""
    values.write.format(sink_format).options(**options).mode("append").save(path)
