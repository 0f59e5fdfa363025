"""MD5 digests of consecutive slices of a topic, and their comparison between topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaygauge.operators.archive import DESTINATION, SOURCE, latest_by_key, test_roles
from relaygauge.operators.positions import (
    SLICE_SIZE,
    TOPIC_KEY,
    bucketed_positions,
    bucketed_row_key_positions,
    dense_positions,
    message_positions,
    offset_buckets,
    positions_in_slices,
    slice_number,
    stored_positions,
)
from relaygauge.schemas import MESSAGE_KEY


def _with_text(messages: DataFrame, strict: bool, *more: str) -> DataFrame:
    """Messages reduced to what a digest needs, as ``_text``.

    In strict mode that is the digest of each payload, so that neither a moved message boundary
    nor an empty payload goes unseen, and payloads need no shuffle at all.
    """
    text = F.coalesce("payload", F.lit(""))
    return messages.select(
        *TOPIC_KEY, "partition", "offset", (F.md5(text) if strict else text).alias("_text"), *more
    )


def _joined(order: str) -> str:
    return f"coalesce(listagg(_text, '') WITHIN GROUP (ORDER BY {order}), '')"


def _digest(counted: DataFrame, buckets: list[str], slice_size: int) -> DataFrame:
    # Messages lie partitioned by bucket, and most slices lie within one bucket: these are
    # digested in place.  Only the texts of slices that cross a bucket edge move again.
    whole = F.col("_n") == slice_size
    parts = (
        counted.withColumn("slice", slice_number(F.col("position"), slice_size))
        .groupBy(*TOPIC_KEY, *buckets, "slice")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.min("position").alias("_first"),
            F.expr(_joined("position")).alias("_text"),
        )
        .select(
            *TOPIC_KEY,
            "slice",
            "_n",
            "_first",
            F.when(whole, F.md5("_text")).alias("_digest"),
            F.when(~whole, F.col("_text")).alias("_text"),
        )
    )
    return parts.groupBy(*TOPIC_KEY, "slice").agg(
        F.sum("_n").alias("messages"),
        F.coalesce(F.max("_digest"), F.md5(F.expr(_joined("_first")))).alias("digest"),
    )


def slice_digests(messages: DataFrame, slice_size: int = SLICE_SIZE, strict: bool = False) -> DataFrame:
    """(test_id, topic, slice, messages, digest): MD5 over the joined payloads of each slice."""
    counted, buckets = bucketed_positions(_with_text(messages, strict))
    return _digest(counted, buckets, slice_size)


def slice_digests_ordered(located: DataFrame, slice_size: int = SLICE_SIZE, strict: bool = False) -> DataFrame:
    """As ``slice_digests`` on an archive that is stored by buckets of offsets: payloads stay where they lie,
    but for those of slices that cross a bucket's edge, at most two of each bucket."""
    text = _with_text(located, strict, *offset_buckets())
    counted, buckets = stored_positions(text)
    return _digest(counted, buckets, slice_size)


def digests_of_slices(
    messages: DataFrame,
    slices: DataFrame,
    slice_size: int = SLICE_SIZE,
    keys: DataFrame | None = None,
    version: str | None = None,
) -> DataFrame:
    """The digests of some ``slices`` (test_id, slice) only; other payloads are not shuffled.

    Of messages with a ``version`` the newest of each counts; ``keys`` then has each message once.
    """
    texts = _with_text(messages, False, *([version] if version else []))
    newest = (lambda chosen: latest_by_key(chosen, MESSAGE_KEY, version)) if version else (lambda chosen: chosen)
    counted, buckets = positions_in_slices(texts, slices, slice_size, keys, newest)
    return _digest(counted, buckets, slice_size).join(slices, ["test_id", "slice"], "left_semi")


def slice_digests_dense(messages: DataFrame, slice_size: int = SLICE_SIZE, strict: bool = False) -> DataFrame:
    """As ``slice_digests`` where offsets have no gaps: one shuffle, straight to the slices."""
    counted = dense_positions(_with_text(messages, strict))
    return (
        counted.withColumn("slice", slice_number(F.col("position"), slice_size))
        .groupBy(*TOPIC_KEY, "slice")
        .agg(F.count(F.lit(1)).alias("messages"), F.md5(F.expr(_joined("position"))).alias("digest"))
    )


def message_prints(messages: DataFrame, version: str | None = None) -> DataFrame:
    """The keys of messages with two 64-bit prints of the payload, made where the message lies.

    Of messages with a ``version`` the newest of each counts: prints settle that, not payloads.
    """
    text = F.coalesce("payload", F.lit(""))
    prints = messages.select(
        *MESSAGE_KEY,
        F.xxhash64(text).alias("_print0"),
        F.xxhash64(F.lit(1), text).alias("_print1"),
        *([version] if version else []),
    )
    return latest_by_key(prints, MESSAGE_KEY, version) if version else prints


def slice_fingerprints(
    prints: DataFrame, slice_size: int = SLICE_SIZE, dense: bool = False, bounds: DataFrame | None = None
) -> DataFrame:
    """As ``slice_digests``, with 128-bit prints of the messages' places and payloads as digests.

    ``prints`` comes from ``message_prints``.  Prints of messages combine in any order, so tasks
    combine theirs before the shuffle.  They rest on a fast hash, not a cryptographic one: chance
    makes no two alike, but someone who chooses payloads could.  Use ``strict`` digests against that.
    """
    placed = dense_positions(prints, bounds) if dense else message_positions(prints)
    combined = [F.hex(F.bit_xor(F.xxhash64("position", f"_print{i}"))) for i in (0, 1)]
    return (
        placed.withColumn("slice", slice_number(F.col("position"), slice_size))
        .groupBy(*TOPIC_KEY, "slice")
        .agg(F.count(F.lit(1)).alias("messages"), F.concat_ws("-", *combined).alias("digest"))
    )


def slice_digests_by_row_key(
    messages: DataFrame, slice_size: int = SLICE_SIZE, strict: bool = False
) -> DataFrame:
    """As ``slice_digests`` in the textual order of joined row keys."""
    counted, buckets = bucketed_row_key_positions(_with_text(messages, strict))
    return _digest(counted, buckets, slice_size)


def compare_slices(digests: DataFrame, tests: DataFrame) -> DataFrame:
    """Source and destination digest side by side for each slice of each test.

    A topic that ends early counts as empty text in the remaining slices.
    """
    rows = digests.join(test_roles(tests), TOPIC_KEY)

    def side(role: str) -> list:
        own = F.col("role") == role
        return [
            F.coalesce(F.max(F.when(own, F.col("digest"))), F.md5(F.lit(""))).alias(f"{role}_digest"),
            F.coalesce(F.sum(F.when(own, F.col("messages"))), F.lit(0)).alias(f"{role}_messages"),
        ]

    compared = rows.groupBy("test_id", "slice").agg(*side(SOURCE), *side(DESTINATION))
    return compared.withColumn("same", F.col("source_digest") == F.col("destination_digest"))
