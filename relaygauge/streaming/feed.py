"""The live feed: charted events of the results topic, forwarded as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from relaygauge.operators.series import chart_events
from relaygauge.schemas import LATENCY_EVENT
from relaygauge.sources.results import decode_reports, event_json, live_feed, reported_once
from relaygauge.streaming import LATENCY_INTERVAL


def feed_stream(
    values: DataFrame,
    target: str,
    checkpoint: str,
    sink_format: str,
    path: str | None = None,
    trigger: dict = LATENCY_INTERVAL,
    once_within: str | None = None,
    **options: str,
) -> StreamingQuery:
    """Forward the live feed of a stream of result values as JSON objects to the topic ``target``.

    An event's own topic is the one that is measured; the feed never goes there by itself.  With ``once_within``,
    a span of time as "10 minutes", values carry the batch of their report, and what a batch that was run again
    sent a second time within that span is left out.
    """
    if once_within is None:
        events = live_feed(values)
    else:
        events = chart_events(reported_once(decode_reports(values), once_within)).select(*LATENCY_EVENT.names)
    feed = events.select(F.lit(target).alias("topic"), event_json().alias("value"))
    return (
        feed.writeStream.format(sink_format)
        .options(**options)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start(path)
    )
