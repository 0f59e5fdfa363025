"""Lines of text as topic messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaygauge.functions.text import count_lines, split_lines, utf8_bytes
from relaygauge.operators.totals import running_total, whole_number_levels

# Texts are larger than messages, so fewer go into one bucket.
TEXT_BUCKET_BITS = (12, 24)


def text_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line) for each line of each text."""
    lines = F.posexplode_outer(split_lines(F.col(text))).alias("line_no", "line")
    return texts.select(F.col(key), lines).where(F.col("line_no").isNotNull())


def lines_to_messages(texts: DataFrame, key: str, text: str, topic: str, partitions: int) -> DataFrame:
    """Lines of texts as unkeyed topic rows, offsets counted from 0 in each partition by text
    and line.

    Line counts of whole texts are summed up, so a text is numbered as one row and unfolds
    last.  For topics kept in files; a broker assigns partition and offset itself.
    """
    if partitions < 1:
        raise ValueError("a topic has at least one partition")
    placed = texts.select(
        F.lit(topic).alias("topic"),
        F.pmod(F.col(key), F.lit(partitions)).cast("int").alias("partition"),
        F.col(key).alias("_key"),
        F.col(text).alias("_text"),
    )
    levels = whole_number_levels(F.col("_key"), bits=TEXT_BUCKET_BITS)
    count = count_lines(F.col("_text"))
    numbered = running_total(placed, ["topic", "partition"], ["_key"], levels, count, "_end")
    lines = numbered.select(
        "topic", "partition", "_end", split_lines(F.col("_text")).alias("_lines")
    ).select("topic", "partition", (F.col("_end") - F.size("_lines")).alias("_start"), F.posexplode_outer("_lines"))
    # The outer form keeps Spark from splitting each text twice to filter out empty ones first.
    return lines.where(F.col("pos").isNotNull()).select(
        "topic", "partition", (F.col("_start") + F.col("pos")).alias("offset"), utf8_bytes(F.col("col")).alias("value")
    )


def newline_terminated(lines: DataFrame) -> DataFrame:
    """Lines as the bytes of an export, each with its line break."""
    return lines.withColumn("line", F.concat("line", F.lit("\n")))
