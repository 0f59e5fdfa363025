"""Time columns that give the same answer in every session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from relaygauge.functions.numbers import int_div


def epoch_micros(wall: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp read as UTC."""
    minutes = F.hour(wall).cast("bigint") * 60 + F.minute(wall)
    micros = (F.extract(F.lit("SECOND"), wall) * 1_000_000).cast("bigint")
    return F.unix_date(wall.cast("date")).cast("bigint") * 86_400_000_000 + minutes * 60_000_000 + micros


def seconds_of(micros: Column) -> Column:
    return int_div(micros, 1_000_000)


def nanos_of_millis(millis: Column) -> Column:
    return millis.cast("bigint") * 1_000_000
