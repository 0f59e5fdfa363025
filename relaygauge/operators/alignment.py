"""Comparison of topics by slices whose bounds depend on the messages, so that it finds its place again.

A message whose own print says so begins a slice.  A message that is lost, added or changed then touches its own slice,
or two if it was a bound, and all others are found again on the other side, wherever they lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaygauge.operators.archive import DESTINATION, SOURCE, test_roles
from relaygauge.operators.positions import SLICE_SIZE, TOPIC_KEY, message_positions
from relaygauge.operators.totals import running_total, whole_number_levels

BLOCK_BITS = 15


def content_prints(messages: DataFrame, slice_size: int = SLICE_SIZE) -> DataFrame:
    """Keys and prints of messages, and whether a message begins a slice, as one in ``slice_size`` does."""
    text = F.coalesce("payload", F.lit(""))
    digits = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return messages.select(
        *TOPIC_KEY,
        "partition",
        "offset",
        (digits % slice_size == 0).alias("bound"),
        F.xxhash64(text).alias("print0"),
        F.xxhash64(F.lit(1), text).alias("print1"),
    )


def slice_starts(prints: DataFrame) -> DataFrame:
    """Prints with their ``position`` and the number of their ``slice``, from 0 before the first bound."""
    placed = message_positions(prints).withColumn("_begins", F.col("bound").cast("bigint"))
    levels = whole_number_levels(F.col("position"))
    return running_total(placed, TOPIC_KEY, ["position"], levels, F.col("_begins"), "slice").select(
        *TOPIC_KEY, "slice", "position", "print0", "print1"
    )


def content_slices(sliced: DataFrame) -> DataFrame:
    """(test_id, topic, slice, first, messages, digest): slices with the position of their first message.

    Prints of a slice combine with the messages' places in it, in any order and before the shuffle, so a
    slice of any length, as of a message repeated without end, is no task of its own.
    """
    # A slice of all messages would be one hot key; its start reaches them by blocks of positions.
    block = F.shiftright("position", BLOCK_BITS).alias("_block")
    starts = sliced.groupBy(*TOPIC_KEY, "slice").agg(F.min("position").alias("first"), F.max("position").alias("_last"))
    reach = F.explode(F.sequence(F.shiftright("first", BLOCK_BITS), F.shiftright("_last", BLOCK_BITS)))
    met = sliced.select("*", block).join(
        starts.select(*TOPIC_KEY, "slice", "first", reach.alias("_block")), [*TOPIC_KEY, "slice", "_block"]
    )
    place = F.col("position") - F.col("first")
    combined = [F.hex(F.bit_xor(F.xxhash64(place, f"print{i}"))) for i in (0, 1)]
    return met.groupBy(*TOPIC_KEY, "slice").agg(
        F.min("first").alias("first"),
        F.count(F.lit(1)).alias("messages"),
        F.concat_ws("-", *combined).alias("digest"),
    )


def align_slices(slices: DataFrame, tests: DataFrame) -> DataFrame:
    """Slices of both topics of each test with the one they equal on the other side.

    (test_id, digest, nth, source_slice, source_first, destination_slice, destination_first, messages); equal slices
    of one topic meet in their order, and a slice that the other topic lacks has nulls there.
    """
    roles = slices.join(test_roles(tests), TOPIC_KEY)
    # The nth of equal slices: numbered by a running total, as all slices of a topic may be equal.
    keyed = roles.withColumn("_key", F.concat_ws("|", "test_id", "role", "digest"))
    numbered = running_total(keyed, ["_key"], ["slice"], whole_number_levels(F.col("slice")), F.lit(1), "nth")
    sides = {
        role: numbered.where(F.col("role") == role).select(
            "test_id", "digest", "messages", "nth", F.col("slice").alias(f"{role}_slice"), F.col("first").alias(f"{role}_first")
        )
        for role in (SOURCE, DESTINATION)
    }
    return sides[SOURCE].join(sides[DESTINATION], ["test_id", "digest", "messages", "nth"], "full")


def alignment_report(aligned: DataFrame, tests: DataFrame) -> DataFrame:
    """One row per test: slices of both topics, those that the other lacks, seams, and the first place that differs.

    A seam is where two slices that follow each other in the source are both in the destination, but not one
    after the other.  ``aligned`` tells that all slices meet and follow each other.
    """
    source, other = F.col(f"{SOURCE}_slice"), F.col(f"{DESTINATION}_slice")
    matched = source.isNotNull() & other.isNotNull()
    following = aligned.where(matched).select("test_id", source.alias("a"), other.alias("b"))
    after = following.select("test_id", (F.col("a") - 1).alias("a"), F.col("b").alias("_next"))
    seams = (
        following.join(after, ["test_id", "a"]).where(F.col("_next") != F.col("b") + 1).groupBy("test_id").agg(F.count(F.lit(1)).alias("seams"))
    )
    lacking = F.when(other.isNull(), F.col(f"{SOURCE}_first"))
    found = aligned.groupBy("test_id").agg(
        F.count(source).alias("source_slices"),
        F.count(other).alias("destination_slices"),
        F.count_if(other.isNull()).alias("only_source"),
        F.count_if(source.isNull()).alias("only_destination"),
        F.min(lacking).alias("first_lacking"),
    )
    counts = ["source_slices", "destination_slices", "only_source", "only_destination", "seams"]
    report = tests.select("test_id").join(found, "test_id", "left").join(seams, "test_id", "left").na.fill(0, counts)
    whole = (F.col("only_source") == 0) & (F.col("only_destination") == 0) & (F.col("seams") == 0)
    return report.select("test_id", *counts, "first_lacking", whole.alias("aligned"))
