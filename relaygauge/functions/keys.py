"""Labels and composite keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Window units and the label of a rolling average.
UNIT_SECONDS = {"second": 1, "minute": 60}
AVERAGE_LABEL = "avg%d%s"


def window_seconds(unit: str, length: int) -> int:
    if unit not in UNIT_SECONDS:
        raise ValueError(f"unknown window unit {unit!r}")
    if length < 1:
        raise ValueError("a window is at least one unit long")
    return UNIT_SECONDS[unit] * length


def average_label(unit: str, length: int) -> str:
    return AVERAGE_LABEL % (length, unit)


def row_key() -> Column:
    """The joined row key without separators.  Different messages may share one: partition 1
    with offset 12 and partition 11 with offset 2 do."""
    return F.concat(F.col("test_id"), F.col("topic"), row_key_digits())


def row_key_digits() -> Column:
    """The part of the joined key that orders the messages of one topic."""
    return F.concat(F.col("partition").cast("string"), F.col("offset").cast("string"))


def separated_row_key() -> Column:
    """A row key that is unique and sorts like (test, topic, partition, offset)."""
    return F.concat_ws(
        "\u0001",
        F.col("test_id"),
        F.col("topic"),
        F.lpad(F.col("partition").cast("string"), 10, "0"),
        F.lpad(F.col("offset").cast("string"), 20, "0"),
    )
