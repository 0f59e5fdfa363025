"""Archiving topic messages: projection, end markers, counts, upserts, test registry."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relaygauge.functions.keys import row_key
from relaygauge.functions.text import faithful_text, utf8_bytes
from relaygauge.schemas import MESSAGE, MESSAGE_KEY, TEST

SOURCE = "source"
DESTINATION = "destination"


def project_messages(envelopes: DataFrame, test_id: str | Column) -> DataFrame:
    """Topic rows as messages of one test, the value as text that loses no byte."""
    run = F.lit(test_id) if isinstance(test_id, str) else test_id
    return envelopes.select(
        run.alias("test_id"), "topic", "partition", "offset", faithful_text(F.col("value")).alias("payload")
    )


def is_marker(marker: str) -> Column:
    """Whether a message is the run's end marker, by bytes and null-safe."""
    return F.col("payload").eqNullSafe(F.lit(marker))


def drop_markers(messages: DataFrame, marker: str) -> DataFrame:
    return messages.where(~is_marker(marker))


Partitions = int | Mapping[str, int]


def end_markers(tests: DataFrame, partitions: Partitions, marker: str) -> DataFrame:
    """One marker for each partition of both topics of each test.

    ``partitions`` is the number of each topic's, by its name, or one number for all topics.
    """
    counts = [partitions] if isinstance(partitions, int) else list(partitions.values())
    if not counts or min(counts) < 1:
        raise ValueError("a topic has at least one partition")
    topics = F.explode(F.array("source_topic", "destination_topic")).alias("topic")
    number = F.lit(partitions) if isinstance(partitions, int) else F.lit(None).cast("int")
    for topic, n in {} if isinstance(partitions, int) else partitions.items():
        number = F.when(F.col("topic") == topic, n).otherwise(number)
    # A topic left out would not be waited for, and its run would seem to have ended.
    unknown = F.raise_error(F.concat(F.lit("no number of partitions is given for topic "), F.col("topic")))
    number = F.coalesce(number, unknown.cast("int"))
    return tests.select("test_id", topics).select(
        "test_id",
        "topic",
        F.explode(F.sequence(F.lit(0), number - 1)).alias("partition"),
        F.lit(marker).alias("payload"),
    )


def marker_values(tests: DataFrame, partitions: Partitions, marker: str) -> DataFrame:
    """The end markers as rows for a topic: (topic, partition, value)."""
    markers = end_markers(tests, partitions, marker).select("topic", "partition").distinct()
    return markers.select("topic", "partition", utf8_bytes(F.lit(marker)).alias("value"))


def stream_progress(messages: DataFrame, tests: DataFrame, partitions: Partitions, marker: str) -> DataFrame:
    """Markers seen and whether reading is done, for each expected (test, topic, partition).

    A partition is done with its first marker, so copied markers do no harm and the two topics
    may end at different times.
    """
    seen = (
        messages.where(is_marker(marker))
        .groupBy("test_id", "topic", "partition")
        .agg(F.count(F.lit(1)).alias("markers"))
    )
    return expected_progress(seen, tests, partitions)


def expected_progress(seen: DataFrame, tests: DataFrame, partitions: Partitions) -> DataFrame:
    """Counted markers (test, topic, partition, markers) against the partitions that should show one."""
    expected = end_markers(tests, partitions, "").drop("payload")
    markers = F.coalesce("markers", F.lit(0))
    return expected.join(seen, ["test_id", "topic", "partition"], "left").select(
        "test_id", "topic", "partition", markers.alias("markers"), (markers > 0).alias("done")
    )


def topic_counts(messages: DataFrame) -> DataFrame:
    """Messages per (test, topic), end markers included if they are in the input."""
    return messages.groupBy("test_id", "topic").agg(F.count(F.lit(1)).alias("total"))


def archive_counts(messages: DataFrame, marker: str) -> DataFrame:
    """Messages per (test, topic) without end markers."""
    return topic_counts(drop_markers(messages, marker))


def latest_by_key(rows: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """One row per key, the one of the highest version.

    An aggregate, not a window: copies of a hot key collapse before the shuffle.
    """
    rest = [c for c in rows.columns if c not in keys and c != version]
    newest = F.max(F.struct(version, *rest)).alias("_newest")
    return (
        rows.groupBy(*keys)
        .agg(newest)
        .select(*[c if c in keys else F.col("_newest")[c].alias(c) for c in rows.columns if c != version])
    )


def archive_messages(messages: DataFrame, version: str) -> DataFrame:
    """The archive: a message read again replaces its earlier copy."""
    return latest_by_key(messages.select(*MESSAGE.names, version), MESSAGE_KEY, version)


def archive_messages_by_row_key(messages: DataFrame, version: str) -> DataFrame:
    """The archive under joined row keys, where colliding keys overwrite each other."""
    keyed = messages.select(row_key().alias("id"), *MESSAGE.names, version)
    return latest_by_key(keyed, ["id"], version)


def register_tests(spark: SparkSession, tests: Sequence[tuple[str, ...]]) -> DataFrame:
    """Test rows (test_id, source_topic, destination_topic) to append to the registry.

    A test given by its topics alone gets an id of its own.
    """
    rows = [tuple(test) if len(test) == 3 else (str(uuid4()), *test) for test in tests]
    for row in rows:
        if len(row) != 3 or not all(row):
            raise ValueError("a test needs a source topic and a destination topic, and an id if any")
    return spark.createDataFrame(rows, TEST)


def lookup_tests(tests: DataFrame, wanted: DataFrame) -> DataFrame:
    """The registered tests for the wanted ids; unknown ids come back as NO_SUCH_TEST."""
    found = tests.select("test_id", "source_topic", "destination_topic", F.lit("FOUND").alias("status"))
    return wanted.select("test_id").join(found, "test_id", "left").select(
        "test_id",
        "source_topic",
        "destination_topic",
        F.coalesce("status", F.lit("NO_SUCH_TEST")).alias("status"),
    )


def test_roles(tests: DataFrame) -> DataFrame:
    """Tests as rows (test_id, topic, role)."""
    roles = F.array(
        F.struct(F.col("source_topic").alias("topic"), F.lit(SOURCE).alias("role")),
        F.struct(F.col("destination_topic").alias("topic"), F.lit(DESTINATION).alias("role")),
    )
    return tests.select("test_id", F.inline(roles))


test_roles.__test__ = False  # not a test case, whatever its name
