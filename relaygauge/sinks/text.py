"""Text exports and verdict reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaygauge.operators.verdicts import REPORT_TITLE


def write_lines(lines: DataFrame, path: str) -> None:
    """Newline-terminated text, one file per task."""
    lines.select("line").write.mode("overwrite").text(path)


def report_lines(report: DataFrame) -> DataFrame:
    """The printed form of a report: title, count and order line of each test, numbered.

    An unknown test has its one line and no title.
    """
    found = F.col("status") == "FOUND"
    lines = F.when(found, F.array(F.lit(REPORT_TITLE), "count_line", "order_line")).otherwise(
        F.array("count_line")
    )
    return report.select("test_id", F.posexplode(lines).alias("line_no", "line"))


def write_report(report: DataFrame, path: str) -> None:
    """One text file per test, in a folder named after it.  A report is a few lines per test."""
    (
        report_lines(report)
        .repartition("test_id")
        .sortWithinPartitions("test_id", "line_no")
        .select("test_id", "line")
        .write.mode("overwrite")
        .partitionBy("test_id")
        .text(path)
    )
