"""Schemas of the tables, topics and records the library reads and writes."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    DataType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(**fields: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


_text, _whole = StringType(), LongType()

# Column names, types and keys of the stored tables.
TOPIC = _struct(
    topic=_text,
    partition=IntegerType(),
    offset=_whole,
    timestamp=TimestampType(),
    key=BinaryType(),
    value=BinaryType(),
)
TEST = _struct(test_id=_text, source_topic=_text, destination_topic=_text)
MESSAGE = _struct(test_id=_text, topic=_text, partition=IntegerType(), offset=_whole, payload=_text)
MARKER = _struct(test_id=_text, topic=_text, partition=IntegerType(), markers=_whole)
NODE = _struct(
    test_id=_text,
    topic=_text,
    partition=IntegerType(),
    level=IntegerType(),
    node=_whole,
    messages=_whole,
    print0=_whole,
    print1=_whole,
)
COUNTER = _struct(test_id=_text, topic=_text, total=_whole)
TIMINGS = ArrayType(_struct(key=_text, value=_whole))
LATENCY_RECORD = _struct(tag=MapType(_text, _text), timings=TIMINGS, arrived_at=TimestampType())
LATENCY_EVENT = _struct(
    topic=_text,
    partition=_text,
    consumerid=_text,
    eventname=_text,
    second=_whole,
    operation=_text,
    value=_whole,
    cnt=_whole,
)
# Windows that end at the seconds ``from`` to ``until`` - 1 with one value: an event for each of them.
LATENCY_SPAN = _struct(
    **{"topic": _text, "partition": _text, "consumerid": _text, "eventname": _text, "operation": _text, "from": _whole},
    until=_whole,
    value=_whole,
    cnt=_whole,
)
BUCKET = _struct(
    topic=_text, partition=_text, consumerid=_text, eventname=_text, second=_whole, total=_whole, cnt=_whole
)
METRIC_RECORD = _struct(id=_whole, timings=MapType(_text, _whole), value=BinaryType())

MESSAGE_KEY = ["test_id", "topic", "partition", "offset"]
COUNTER_KEY = ["test_id", "topic"]
EVENT_KEY = ["topic", "second", "partition", "consumerid", "eventname", "operation"]
SERIES_KEY = ["topic", "partition", "consumerid", "eventname"]
