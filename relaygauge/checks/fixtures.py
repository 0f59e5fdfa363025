"""Topics, archives and latency records as views of the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from relaygauge.functions.clock import epoch_micros
from relaygauge.functions.frames import build_frame
from relaygauge.functions.text import utf8_bytes
from relaygauge.operators.archive import end_markers, register_tests
from relaygauge.operators.latencies import latency_buckets
from relaygauge.operators.lines import text_lines
from relaygauge.operators.rolling import rolling_averages, rolling_spans
from relaygauge.schemas import LATENCY_RECORD, MESSAGE

PARTITIONS = 4
MARKER = "end-of-stream"
CHANGED_EVENT = 777
TESTS = [(name, "src", "dst") for name in ("faithful", "dropped", "edited")]
RESULT_WINDOWS = [("second", 10), ("second", 30)]
AFTER_ALL_OFFSETS = 10**12


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events")


def payload() -> Column:
    return F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "props")


def partition_of(partitions: int = PARTITIONS) -> Column:
    return F.pmod("user_id", F.lit(partitions)).cast("int")


def topic_rows(rows: DataFrame, topic: str, broken: Column | None = None) -> DataFrame:
    """Events as a topic; offsets keep the gaps that a compacted topic has.  ``broken`` are values
    to put in place of the usual ones where not null."""
    return rows.select(
        F.lit(topic).alias("topic"),
        partition_of().alias("partition"),
        F.col("event_id").alias("offset"),
        F.timestamp_micros(epoch_micros(F.col("ts"))).alias("timestamp"),
        F.lit(None).cast("binary").alias("key"),
        F.coalesce(F.lit(None).cast("binary") if broken is None else broken, utf8_bytes(payload())).alias("value"),
    )


def tests(spark: SparkSession) -> DataFrame:
    return register_tests(spark, TESTS)


def archive(spark: SparkSession, folder: str, partitions: int = PARTITIONS) -> DataFrame:
    """Source and destination of each test: a faithful copy, one that lost a message and one
    that changed a message."""
    copies = F.array(
        *[
            F.struct(F.lit(test).alias("test_id"), F.lit(topic).alias("topic"))
            for test, *topics in TESTS
            for topic in topics
        ]
    )
    changed = (F.col("topic") == "dst") & (F.col("offset") == CHANGED_EVENT)
    edited = changed & (F.col("test_id") == "edited")
    return (
        events(spark, folder)
        .select(
            F.inline(copies),
            partition_of(partitions).alias("partition"),
            F.col("event_id").alias("offset"),
            payload().alias("payload"),
        )
        .where(~(changed & (F.col("test_id") == "dropped")))
        .withColumn("payload", F.when(edited, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    )


def marked_archive(spark: SparkSession, folder: str) -> DataFrame:
    """The archive with end markers, of which one partition still lacks its own."""
    markers = end_markers(tests(spark), PARTITIONS, MARKER).where(
        "NOT (test_id = 'dropped' AND topic = 'dst' AND partition = 3)"
    )
    marked = markers.withColumn("offset", F.lit(AFTER_ALL_OFFSETS)).select(*MESSAGE.names)
    return archive(spark, folder).unionByName(marked)


def delivered_twice(spark: SparkSession, folder: str) -> DataFrame:
    """Messages with a delivery number; purchases came again with another payload."""
    rounds = F.sequence(F.lit(0).cast("bigint"), (F.col("event_type") == "purchase").cast("bigint"))
    again = F.when(F.col("delivery") == 1, F.concat(payload(), F.lit("#2"))).otherwise(payload())
    return (
        events(spark, folder)
        .select("*", F.explode(rounds).alias("delivery"))
        .select(
            F.lit("faithful").alias("test_id"),
            F.lit("src").alias("topic"),
            partition_of(16).alias("partition"),
            F.col("event_id").alias("offset"),
            again.alias("payload"),
            "delivery",
        )
    )


def _mark(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), value.alias("value"))


def records_of(rows: DataFrame) -> DataFrame:
    """Latency records: three tags and three timing marks per event."""
    at = epoch_micros(F.col("ts"))
    return rows.select(
        "event_id",
        "event_type",
        F.create_map(
            F.lit("topic"),
            F.col("event_type"),
            F.lit("partition"),
            F.pmod("user_id", F.lit(4)).cast("string"),
            F.lit("consumerId"),
            F.pmod("user_id", F.lit(2)).cast("string"),
        ).alias("tag"),
        F.array(
            _mark("created", at),
            _mark("consumed", at + F.col("event_id") * 37 % 5000),
            _mark("produced", at + F.col("event_id") * 91 % 7000),
        ).alias("timings"),
        F.timestamp_micros(at).alias("arrived_at"),
    )


def records(spark: SparkSession, folder: str) -> DataFrame:
    return records_of(events(spark, folder))


RECORD_FIELDS = StructType([f for f in LATENCY_RECORD.fields if f.name != "arrived_at"])


def framed_records(spark: SparkSession, folder: str) -> DataFrame:
    """Latency records as a topic of framed JSON."""
    body = utf8_bytes(F.to_json(F.struct("tag", "timings")))
    frame = build_frame(F.lit(7), body)
    broken = F.concat(F.unhex(F.lit("01")), F.substr(frame, F.lit(2)))
    return records(spark, folder).select(
        F.when(F.col("event_type") == "error", broken).otherwise(frame).alias("value"),
        F.col("arrived_at").alias("timestamp"),
    )


def records_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Records of which some lack a tag or all tags."""
    gaps = F.when(F.col("event_type") == "error", F.map_filter("tag", lambda k, _: k != "consumerId")).when(
        F.col("event_type") != "signup", F.col("tag")
    )
    return records(spark, folder).withColumn("tag", gaps)


def records_with_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Records of which some repeat a mark, or repeat a key with another value."""
    first = F.element_at("timings", 1)
    repeated = (
        F.when(F.col("event_type") == "view", F.concat("timings", F.array(first)))
        .when(F.col("event_type") == "click", F.concat("timings", F.array(_mark("created", first["value"] + 5))))
        .when(F.col("event_type") == "error", F.slice("timings", 1, 1))
        .otherwise(F.col("timings"))
    )
    return records(spark, folder).withColumn("timings", repeated)


def buckets(spark: SparkSession, folder: str) -> DataFrame:
    return latency_buckets(records(spark, folder))


def result_spans(spark: SparkSession, folder: str) -> DataFrame:
    """The latency events of ``results``, those of consecutive seconds with one value in one row."""
    return rolling_spans(buckets(spark, folder), RESULT_WINDOWS)


def results(spark: SparkSession, folder: str) -> DataFrame:
    """Latency events of two windows, reported every second."""
    return rolling_averages(buckets(spark, folder), RESULT_WINDOWS)


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """Framed values: some of another format, some cut short."""
    kind = F.col("event_type")
    schema_id = F.when(kind == "click", 1).when(kind == "purchase", 2).when(kind == "view", 3).otherwise(900000)
    frame = build_frame(schema_id, utf8_bytes(F.col("props")))
    value = (
        F.when(F.pmod("user_id", F.lit(10)) == 0, F.substring(frame, 1, 3))
        .when(kind == "error", F.concat(F.unhex(F.lit("01")), F.substr(frame, F.lit(2))))
        .otherwise(frame)
    )
    return events(spark, folder).select("event_id", value.alias("value"))


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    return text_lines(table(spark, folder, "documents"), "doc_id", "text")
