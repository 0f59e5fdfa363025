"""Topic rows from a broker or from files.

The broker format needs Spark's Kafka package on the cluster; topics kept as files have the
same columns.  Either way one task reads one partition or file split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaygauge.schemas import TOPIC

BROKER_FORMAT = "kafka"


def read_topic(
    spark: SparkSession, source_format: str = BROKER_FORMAT, path: str | None = None, **options: str
) -> DataFrame:
    """A bounded read: all rows between the given offsets, or all files."""
    reader = spark.read.format(source_format).options(**options)
    if source_format == BROKER_FORMAT:
        return reader.load().select(*TOPIC.names)
    return reader.schema(TOPIC).load(path)


def stream_topic(
    spark: SparkSession, source_format: str = BROKER_FORMAT, path: str | None = None, **options: str
) -> DataFrame:
    """The same as a stream; a broker topic starts at its latest offsets unless told otherwise."""
    reader = spark.readStream.format(source_format)
    if source_format == BROKER_FORMAT:
        return reader.options(**{"startingOffsets": "latest", **options}).load().select(*TOPIC.names)
    return reader.options(**options).schema(TOPIC).load(path)


def topics_union(*topics: DataFrame) -> DataFrame:
    """Source and destination topic as one table."""
    if not topics:
        raise ValueError("no topics given")
    return reduce(DataFrame.unionByName, topics)


def from_latest(rows: DataFrame, start_micros: int, time: str = "timestamp") -> DataFrame:
    """Rows that arrived at or after a start, as a reader that begins at the end sees them."""
    return rows.where(F.col(time) >= F.timestamp_micros(F.lit(start_micros)))
