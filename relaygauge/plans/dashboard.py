"""What a chart page loads first: the last hour of one topic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaygauge.operators.series import events_history
from relaygauge.sources.results import event_json


def history_json(events: DataFrame, topic: str, now: int) -> DataFrame:
    """The history as JSON objects, one per row, in order of ``second`` and series."""
    history = events_history(events, topic, now)
    return history.select("second", "partition", "consumerid", "eventname", event_json().alias("json")).orderBy(
        F.col("second"), "partition", "consumerid", "eventname"
    )
