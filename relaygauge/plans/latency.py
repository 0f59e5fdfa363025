"""The latency job in one piece: topic rows to latency events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from relaygauge.operators.latencies import latency_buckets
from relaygauge.operators.rolling import WINDOWS, rolling_averages
from relaygauge.schemas import LATENCY_RECORD
from relaygauge.sources.records import Decoder, RecordSchema, decode_records, json_body, split_frames

_RECORD = StructType([f for f in LATENCY_RECORD.fields if f.name != "arrived_at"])


def decode_latency_topic(
    envelopes: DataFrame,
    schemas: Sequence[RecordSchema],
    decode: Decoder = json_body,
) -> DataFrame:
    """Topic rows as latency records, with ``problem`` set on those that are none.

    Timings may be an array of marks or a map of them.  Works on streams as well.
    """
    decoded = decode_records(split_frames(envelopes), schemas, _RECORD, decode)
    return decoded.select("record.*", F.col("timestamp").alias("arrived_at"), "problem")


def latency_report(
    records: DataFrame, windows: Sequence[tuple[str, int]] = WINDOWS, emit_every: int = 1
) -> DataFrame:
    """The latency events of a bounded set of records, for all windows in one pass."""
    return rolling_averages(latency_buckets(records), windows, emit_every)
