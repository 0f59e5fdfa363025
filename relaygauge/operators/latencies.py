"""Latency records to timing pairs and one-second buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaygauge.functions.timings import later_marks
from relaygauge.schemas import SERIES_KEY

# The tags every latency record carries.
TAGS = {"topic": "topic", "partition": "partition", "consumerId": "consumerid"}


def missing_tag() -> Column:
    """The first required tag a record lacks, or null."""
    return F.coalesce(*[F.when(F.col("tag").isNull() | F.col("tag")[t].isNull(), F.lit(t)) for t in TAGS])


def extract_tags(records: DataFrame) -> DataFrame:
    """Records with their tags as columns, ``missing_tag`` naming one a record lacks."""
    return records.select(
        "*", *[F.col("tag")[tag].alias(name) for tag, name in TAGS.items()], missing_tag().alias("missing_tag")
    )


def complete_records(records: DataFrame) -> DataFrame:
    tagged = extract_tags(records)
    return tagged.where("missing_tag IS NULL").drop("missing_tag")


def incomplete_records(records: DataFrame) -> DataFrame:
    """The quarantine: records lacking a tag, with the tag's name."""
    tagged = extract_tags(records)
    return tagged.where("missing_tag IS NOT NULL").select(*records.columns, "missing_tag")


def latency_pairs(records: DataFrame) -> DataFrame:
    """One row per record and two-element combination of its timing marks: the series key,
    arrival and latency.  Rows unfold where the record lies."""
    source = ["topic", "partition", "consumerid", "arrived_at"]
    firsts = (
        complete_records(records)
        .select(*source, "timings", F.array_distinct("timings").alias("marks"))
        .select("*", F.posexplode_outer("marks").alias("place", "first"))
    )
    partners = later_marks(F.col("timings"), F.col("marks"), F.col("place"), F.col("first"))
    # Outer forms, as Spark would otherwise evaluate each array twice, to filter out empty ones.
    pairs = firsts.select(*source, "first", F.explode_outer(partners).alias("last"))
    return pairs.where(F.col("last").isNotNull()).select(
        *source,
        F.concat("first.key", F.lit("-"), "last.key").alias("eventname"),
        (F.col("last.value") - F.col("first.value")).alias("latency"),
    )


def latency_buckets(records: DataFrame) -> DataFrame:
    """Sum and count of latencies per series and second of arrival.

    Pairs are aggregated in the task that makes them; the shuffle carries one row per series,
    second and task, whatever the rate of a series.
    """
    return (
        latency_pairs(records)
        .groupBy(*SERIES_KEY, F.unix_seconds("arrived_at").alias("second"))
        .agg(F.sum("latency").alias("total"), F.count(F.lit(1)).alias("cnt"))
    )
