"""Verdicts on a relay: equal counts, preserved order, and the report of both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaygauge.operators.archive import DESTINATION, SOURCE, test_roles
from relaygauge.operators.positions import TOPIC_KEY

# The lines of a verdict report.
REPORT_TITLE = "***** TEST RESULTS *****"
COUNT_LINE = " - Destination topic contains the same amount of messages as Source topic(%d out of %d): %s"
ORDER_LINE = " - Destination topic preserves ordering of Source topic: %s"
MISSING_LINE = "There is no such test '%s'"


def count_verdict(counts: DataFrame, tests: DataFrame) -> DataFrame:
    """Whether both topics of each test hold equally many messages; no count means zero."""

    def total(role: str):
        return F.coalesce(F.sum(F.when(F.col("role") == role, F.col("total"))), F.lit(0))

    return (
        test_roles(tests)
        .join(counts, TOPIC_KEY, "left")
        .groupBy("test_id")
        .agg(total(SOURCE).alias("source_total"), total(DESTINATION).alias("destination_total"))
        .withColumn("same_amount", F.col("source_total") == F.col("destination_total"))
    )


def _order_columns() -> list:
    return [
        F.bool_and("same").alias("order_preserved"),
        F.min(F.when(~F.col("same"), F.col("slice"))).alias("first_difference"),
    ]


def order_verdict(compared: DataFrame, tests: DataFrame) -> DataFrame:
    """Whether all slices of each test agree, and the first that does not.

    A test without messages has nothing out of order.
    """
    found = compared.groupBy("test_id").agg(*_order_columns())
    return tests.select("test_id").join(found, "test_id", "left").select(
        "test_id",
        F.coalesce("order_preserved", F.lit(True)).alias("order_preserved"),
        "first_difference",
    )


def validation_report(compared: DataFrame, tests: DataFrame) -> DataFrame:
    """One row per test with both verdicts and their printed lines.

    ``tests`` comes from ``lookup_tests``, with unknown ids marked.  Counts are taken from the
    compared slices, so the messages are read for digests and counts together.
    """
    found = compared.groupBy("test_id").agg(
        F.sum("source_messages").alias("source_total"),
        F.sum("destination_messages").alias("destination_total"),
        *_order_columns(),
    )
    known = F.col("status") == "FOUND"
    report = tests.join(found, "test_id", "left").select(
        "test_id",
        "status",
        F.when(known, F.coalesce("source_total", F.lit(0))).alias("source_total"),
        F.when(known, F.coalesce("destination_total", F.lit(0))).alias("destination_total"),
        F.when(known, F.coalesce("order_preserved", F.lit(True))).alias("order_preserved"),
        "first_difference",
    )
    same = F.col("source_total") == F.col("destination_total")
    return report.select(
        "test_id",
        "status",
        "source_total",
        "destination_total",
        same.alias("same_amount"),
        "order_preserved",
        "first_difference",
        F.when(
            known,
            F.format_string(COUNT_LINE, "source_total", "destination_total", F.upper(same.cast("string"))),
        )
        .otherwise(F.format_string(MISSING_LINE, "test_id"))
        .alias("count_line"),
        F.when(
            known, F.format_string(ORDER_LINE, F.upper(F.col("order_preserved").cast("string")))
        ).alias("order_line"),
    )
