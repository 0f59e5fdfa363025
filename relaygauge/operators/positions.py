"""The place of each message in its topic, ordered by partition and offset."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relaygauge.functions.keys import row_key_digits
from relaygauge.functions.numbers import int_div
from relaygauge.operators.totals import (
    BUCKET_BITS,
    bucket_names,
    bucket_totals,
    bucketed_total,
    continued_total,
    whole_number_levels,
)

TOPIC_KEY = ["test_id", "topic"]
SLICE_SIZE = 1000  # fixed value: messages per compared slice

# The finest buckets of the textual order of row keys leave out so many of the longest key's digits.
KEY_DIGITS = 4


def _levels() -> list[list[Column]]:
    return whole_number_levels(F.col("offset"), outer=[F.col("partition")])


def bucketed_positions(messages: DataFrame) -> tuple[DataFrame, list[str]]:
    """Messages with ``position`` (from 1), and the bucket columns they are partitioned by."""
    return bucketed_total(messages, TOPIC_KEY, ["partition", "offset"], _levels(), F.lit(1), "position")


def offset_buckets() -> list[str]:
    """The names of the columns that hold a message's partition and its bucket of offsets."""
    return bucket_names(_levels())[0]


def located_messages(messages: DataFrame) -> DataFrame:
    """Messages with the bucket they lie in, as an ordered archive stores them."""
    return messages.withColumns(dict(zip(offset_buckets(), _levels()[0])))


def stored_positions(located: DataFrame) -> tuple[DataFrame, list[str]]:
    """As ``bucketed_positions`` for messages that are stored by their buckets: they stay where they lie.

    Totals of the buckets join them; they are a row for each, and the only rows to move.
    """
    buckets = offset_buckets()
    bases = bucket_totals(located, TOPIC_KEY, _levels(), F.lit(1)).select(*TOPIC_KEY, *buckets, "_before")
    # Merged, as sides that are sorted by buckets are: no side is copied, whatever its size.
    met = located.join(bases.hint("merge"), [*TOPIC_KEY, *buckets])
    place = F.row_number().over(W.partitionBy(*TOPIC_KEY, *buckets).orderBy("partition", "offset"))
    return met.withColumn("position", F.col("_before") + place).drop("_before"), buckets


def positions_in_slices(
    messages: DataFrame,
    slices: DataFrame,
    slice_size: int,
    keys: DataFrame | None = None,
    newest: Callable[[DataFrame], DataFrame] = lambda chosen: chosen,
) -> tuple[DataFrame, list[str]]:
    """As ``bucketed_positions``, but only for the buckets that reach into the given ``slices``
    (test_id, slice); other messages are left out before the shuffle.

    Where ``messages`` are versions, ``keys`` has each message once, and ``newest`` picks versions
    among the messages that are left.
    """
    bases = bucket_totals(messages if keys is None else keys, TOPIC_KEY, _levels(), F.lit(1))
    first, last = F.col("_before"), F.col("_before") + F.col("_sum") - 1
    reached = bases.select(
        "*", F.explode(F.sequence(int_div(first, slice_size), int_div(last, slice_size))).alias("slice")
    )
    buckets = [name for name in bases.columns if name.startswith("_bucket")]
    touched = reached.join(slices, ["test_id", "slice"], "left_semi").select(*TOPIC_KEY, *buckets, "_before").distinct()
    located = messages.withColumns(dict(zip(buckets, _levels()[0])))
    chosen = located.join(touched, [*TOPIC_KEY, *buckets], "left_semi").drop(*buckets)
    return continued_total(
        newest(chosen), touched, TOPIC_KEY, ["partition", "offset"], _levels(), F.lit(1), "position"
    )


def message_positions(messages: DataFrame) -> DataFrame:
    """Messages with ``position``, whatever gaps the offsets have."""
    counted, buckets = bucketed_positions(messages)
    return counted.drop(*buckets)


def partition_bounds(messages: DataFrame) -> DataFrame:
    """First and last offset and the number of messages of each partition."""
    return messages.groupBy(*TOPIC_KEY, "partition").agg(
        F.min("offset").alias("_first"), F.max("offset").alias("_last"), F.count(F.lit(1)).alias("_n")
    )


def _gapless() -> Column:
    return F.col("_last") - F.col("_first") + 1 == F.col("_n")


def has_dense_offsets(messages: DataFrame, bounds: DataFrame | None = None) -> bool:
    """Whether no partition has a gap in its offsets; reads keys and offsets only."""
    return (partition_bounds(messages) if bounds is None else bounds).where(~_gapless()).isEmpty()


def dense_positions(messages: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Messages with ``position`` where offsets have no gaps: no sort of the messages at all.

    Only the bounds of each partition are computed, unless given.  A bound joins each bucket of its
    partition's offsets, so a partition that holds most messages is no key of its own.  A gap fails
    the job instead of giving wrong positions.
    """
    bounds = partition_bounds(messages) if bounds is None else bounds
    earlier = W.partitionBy(*TOPIC_KEY).orderBy("partition").rowsBetween(W.unboundedPreceding, -1)
    width = BUCKET_BITS[0]
    starts = bounds.select(
        *TOPIC_KEY,
        "partition",
        F.when(_gapless(), F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first"))
        .otherwise(F.raise_error(F.lit("offsets have gaps; use message_positions")))
        .alias("_shift"),
        F.sequence(F.shiftright("_first", width), F.shiftright("_last", width)).alias("_buckets"),
    ).select(*TOPIC_KEY, "partition", "_shift", F.explode("_buckets").alias("_bucket"))
    located = messages.withColumn("_bucket", F.shiftright("offset", width))
    return located.join(starts, [*TOPIC_KEY, "partition", "_bucket"]).select(
        *messages.columns, (F.col("offset") + F.col("_shift") + 1).alias("position")
    )


def bucketed_row_key_positions(messages: DataFrame) -> tuple[DataFrame, list[str]]:
    """As ``bucketed_positions`` in the textual order of joined row keys, where offset 10
    comes before offset 2.

    Messages whose keys collide, as partition 1 with offset 12 and 11 with 2, follow by partition.
    Buckets are prefixes of the keys' digits that leave out a few of the longest one's, so the rows
    of a bucket are bounded however long offsets grow.
    """
    ordered = messages.withColumn("_digits", row_key_digits())
    longest = ordered.agg(F.max(F.length("_digits"))).first()[0] or 1
    lengths = list(range(longest - KEY_DIGITS, 0, -KEY_DIGITS)) or [1]
    levels = [[F.substring("_digits", 1, length)] for length in lengths]
    return bucketed_total(ordered, TOPIC_KEY, ["_digits", "partition"], levels, F.lit(1), "position")


def slice_number(position: Column, slice_size: int) -> Column:
    if slice_size < 1:
        raise ValueError("a slice holds at least one message")
    return int_div(position - 1, slice_size)
