"""Framed messages: a zero byte, a four-byte big-endian schema id, then the body."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the frame format.
MAGIC = 0
HEADER_BYTES = 5


def _unsigned(part: Column) -> Column:
    return F.conv(F.hex(part), 16, 10).cast("bigint")


def frame_problem(value: Column) -> Column:
    """Why a value is no frame, or null when it is one."""
    return (
        F.when(value.isNull() | (F.octet_length(value) < HEADER_BYTES), F.lit("truncated"))
        .when(_unsigned(F.substring(value, 1, 1)) != MAGIC, F.lit("unknown magic byte"))
    )


def frame_schema_id(value: Column) -> Column:
    return F.when(frame_problem(value).isNull(), _unsigned(F.substring(value, 2, 4)))


def frame_body(value: Column) -> Column:
    body = F.substr(value, F.lit(HEADER_BYTES + 1))
    return F.when(frame_problem(value).isNull(), body)


def build_frame(schema_id: Column, body: Column) -> Column:
    prefix = F.unhex(F.lpad(F.hex(schema_id.cast("bigint")), 8, "0"))
    return F.concat(F.unhex(F.lit("00")), prefix, body)
