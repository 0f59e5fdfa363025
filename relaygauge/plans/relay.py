"""The validation job from the topics to the report: archive until both have ended, then validate."""

from __future__ import annotations

from collections import defaultdict
from threading import Condition

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from relaygauge.operators.archive import Partitions
from relaygauge.operators.positions import SLICE_SIZE
from relaygauge.plans.validation import validate_by_fingerprint
from relaygauge.sinks.tables import BATCH
from relaygauge.streaming import ARCHIVE_INTERVAL
from relaygauge.streaming.archive import PROGRESS, archive_stream, read_progress, read_versions_of_messages


class MarkerListener(StreamingQueryListener):
    """Hears from the progress of archive streams which partitions have shown their end markers."""

    def __init__(self) -> None:
        self._heard = Condition()
        self._shown: dict[str, set[tuple[str, int]]] = defaultdict(set)
        self._over: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = (event.progress.observedMetrics or {}).get(PROGRESS)
        if seen is not None:
            with self._heard:
                self._shown[str(event.progress.runId)].update((r["topic"], r["partition"]) for r in seen["ended"] or ())
                self._heard.notify_all()

    def onQueryTerminated(self, event) -> None:
        with self._heard:
            self._over.add(str(event.runId))
            self._heard.notify_all()

    def wait(self, query: StreamingQuery, expected: set[tuple[str, int]], seconds: float) -> bool:
        """Whether a query has shown the markers of all ``expected`` partitions; waits for that or its end, or so long."""
        run = str(query.runId)
        with self._heard:
            self._heard.wait_for(lambda: expected <= self._shown[run] or run in self._over, seconds)
            return expected <= self._shown[run]


def all_ended(progress: DataFrame) -> bool:
    return progress.where(~F.col("done")).isEmpty()


def await_markers(
    query: StreamingQuery,
    listener: MarkerListener,
    root: str,
    tests: DataFrame,
    partitions: Partitions,
    check_seconds: float,
) -> bool:
    """Wait until each partition of both topics has shown its end marker, then stop the stream.

    The stream's progress tells, batch by batch; markers of earlier runs are in the table of markers.  That is
    looked at again every ``check_seconds``, as Spark may drop a message of progress.  Returns whether all
    have ended; a query that ends by itself is not waited for any longer.
    """
    spark = tests.sparkSession
    while True:
        # A row per partition of two topics.
        missing = read_progress(spark, root, tests, partitions).where(~F.col("done")).select("topic", "partition").collect()
        if listener.wait(query, {(r["topic"], r["partition"]) for r in missing}, check_seconds):
            query.stop()
            return True
        if not query.isActive:
            query.awaitTermination()
            return all_ended(read_progress(spark, root, tests, partitions))


def check_relay(
    envelopes: DataFrame,
    tests: DataFrame,
    test_id: str,
    marker: str,
    root: str,
    checkpoint: str,
    partitions: Partitions,
    trigger: dict = ARCHIVE_INTERVAL,
    check_seconds: float = 60,
    slice_size: int = SLICE_SIZE,
) -> DataFrame:
    """The report on one test: its topics are archived below ``root`` until both have ended.

    ``partitions`` is the number of each topic's by name, as the two may differ.  The report's
    ``ended`` tells whether every partition had shown its marker.
    """
    own = tests.where(F.col("test_id") == test_id)
    streams, listener = tests.sparkSession.streams, MarkerListener()
    streams.addListener(listener)
    try:
        query = archive_stream(envelopes, test_id, marker, root, checkpoint, trigger)
        ended = await_markers(query, listener, root, own, partitions, check_seconds)
    finally:
        streams.removeListener(listener)
    messages = read_versions_of_messages(tests.sparkSession, root).where(F.col("test_id") == test_id)
    report = validate_by_fingerprint(messages, own, slice_size=slice_size, version=BATCH)
    return report.withColumn("ended", F.lit(ended))
