"""The archive job: topic messages into the message and counter tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from relaygauge.operators.archive import (
    Partitions,
    drop_markers,
    expected_progress,
    is_marker,
    project_messages,
    topic_counts,
)
from relaygauge.operators.trees import NODE_KEY, tree_nodes
from relaygauge.schemas import COUNTER, COUNTER_KEY, MARKER, MESSAGE, MESSAGE_KEY, NODE
from relaygauge.sinks.levels import LevelledTable, newest_of, summed_by
from relaygauge.sinks.ordered import write_ordered
from relaygauge.sinks.tables import BATCH
from relaygauge.streaming import ARCHIVE_INTERVAL

PROGRESS = "progress"


def messages_table(spark: SparkSession, root: str) -> LevelledTable:
    return LevelledTable(spark, f"{root}/messages", MESSAGE, newest_of(MESSAGE_KEY), tuple(MESSAGE_KEY))


def counters_table(spark: SparkSession, root: str) -> LevelledTable:
    return LevelledTable(spark, f"{root}/counters", COUNTER, summed_by(COUNTER_KEY, ["total"]))


def markers_table(spark: SparkSession, root: str) -> LevelledTable:
    return LevelledTable(spark, f"{root}/markers", MARKER, summed_by(MARKER.names[:3], ["markers"]))


def nodes_table(spark: SparkSession, root: str) -> LevelledTable:
    """Trees of digests of the archived topics, of which each batch adds its part."""

    def added(nodes: DataFrame) -> DataFrame:
        prints = [F.bit_xor(f"print{i}").alias(f"print{i}") for i in (0, 1)]
        return nodes.groupBy(*NODE_KEY).agg(F.sum("messages").alias("messages"), *prints, F.max(BATCH).alias(BATCH))

    return LevelledTable(spark, f"{root}/nodes", NODE, added, ("level", "test_id", "topic", "partition", "node"))


def archive_stream(
    envelopes: DataFrame,
    test_id: str,
    marker: str,
    root: str,
    checkpoint: str,
    trigger: dict = ARCHIVE_INTERVAL,
    files: int | None = None,
    trees: bool = False,
) -> StreamingQuery:
    """Archive a stream of topic rows below ``root``: messages without markers, counts with.

    A batch that is run again is not added again, so no table counts anything twice.  Batches merge
    by levels on the way while they are small; ``messages_table(...).merge()`` merges large ones, beside the
    stream.  A batch writes its messages where they were read, or to so many ``files``.
    The markers of each partition are counted in a table of their own, and those of each batch
    show in the query's progress as an observed metric.  With ``trees``, trees of digests are kept as well.
    """
    # At most a row per partition: those whose marker is in the batch.
    ended = F.collect_set(F.when(is_marker(marker), F.struct("topic", "partition")))
    messages = project_messages(envelopes, test_id).observe(
        PROGRESS,
        F.count(F.lit(1)).alias("messages"),
        F.count_if(is_marker(marker)).alias("markers"),
        ended.alias("ended"),
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            messages_table(spark, root).append(drop_markers(batch, marker), batch_id, files)
            if trees:
                nodes_table(spark, root).append(tree_nodes(drop_markers(batch, marker)), batch_id)
            counters_table(spark, root).append(topic_counts(batch), batch_id)
            # At most a row per batch and partition that has shown one.
            seen = batch.where(is_marker(marker)).groupBy(*MARKER.names[:3]).agg(F.count(F.lit(1)).alias("markers"))
            markers_table(spark, root).append(seen, batch_id)
        finally:
            batch.unpersist()

    return (
        messages.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def read_messages(spark: SparkSession, root: str) -> DataFrame:
    """Archived messages, the newest copy of each.

    Keys alone tell which messages came more than once; only copies of those are compared, so the
    payloads of an archive without copies are not shuffled.
    """
    versions = read_versions_of_messages(spark, root)
    again = versions.groupBy(*MESSAGE_KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    if again.isEmpty():
        return versions.select(*MESSAGE.names)
    newest = newest_of(MESSAGE_KEY)(versions.join(again, MESSAGE_KEY, "left_semi")).select(*MESSAGE.names)
    return versions.join(again, MESSAGE_KEY, "left_anti").select(*MESSAGE.names).unionByName(newest)


def read_versions_of_messages(spark: SparkSession, root: str) -> DataFrame:
    """Archived messages, each copy with its batch; filters and prints need no shuffle of payloads."""
    return messages_table(spark, root).versions()


def order_archive(spark: SparkSession, root: str, path: str, files: int | None = None) -> DataFrame:
    """The archived messages stored anew at ``path`` in the order of offsets, for ``validate_ordered``."""
    return write_ordered(read_messages(spark, root), path, files)


def read_progress(spark: SparkSession, root: str, tests: DataFrame, partitions: Partitions) -> DataFrame:
    """Markers seen so far and whether reading is done, for each expected (test, topic, partition)."""
    return expected_progress(markers_table(spark, root).current(), tests, partitions)


def read_counters(spark: SparkSession, root: str) -> DataFrame:
    """Totals per (test, topic), markers included: the sum over all batches."""
    return counters_table(spark, root).current()
