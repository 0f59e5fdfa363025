"""Whole-number arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(dividend: Column, divisor: Column | int) -> Column:
    """Integer division that truncates toward zero."""
    return F.call_function("div", dividend, F.lit(divisor) if isinstance(divisor, int) else divisor)
