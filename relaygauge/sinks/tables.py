"""Keyed tables as Parquet folders, one version per batch.

Each batch owns its ``batch_id`` folders and rewrites them when it is run again, so a repeated
batch leaves no double rows.  Readers take the newest version of each key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from relaygauge.operators.archive import latest_by_key
from relaygauge.operators.rolling import newest_spans
from relaygauge.schemas import LATENCY_SPAN

BATCH = "batch_id"


def write_batch(
    rows: DataFrame, path: str, batch_id: int, partition_by: Sequence[str] = (), files: int | None = None
) -> None:
    """Write one batch, replacing what an earlier attempt of the same batch left.

    With ``files``, rows are shuffled so that each folder gets so many files at most: for small
    tables that come from many tasks.
    """
    if files is not None:
        salt = F.pmod(F.xxhash64(*rows.columns), F.lit(files))
        rows = rows.repartition(*[F.col(c) for c in partition_by], salt)
    (
        rows.withColumn(BATCH, F.lit(batch_id).cast("bigint"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by, BATCH)
        .parquet(path)
    )


def read_versions(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All versions of all rows, with their batch."""
    return spark.read.schema(StructType([*schema.fields, StructField(BATCH, LongType())])).parquet(path)


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """The current spans of a table of ``LATENCY_SPAN``: of each second of a series the newest version."""
    return newest_spans(read_versions(spark, path, LATENCY_SPAN), BATCH).select(*LATENCY_SPAN.names)


def read_table(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str]) -> DataFrame:
    """The current rows.  Filters on key columns reach the scan."""
    return latest_by_key(read_versions(spark, path, schema), keys, BATCH).select(*schema.names)


def compact(
    spark: SparkSession,
    path: str,
    compacted: str,
    schema: StructType,
    keys: Sequence[str],
    partition_by: Sequence[str] = (),
) -> None:
    """Write the current rows to a new folder, as version 0 of a table to continue on."""
    write_batch(read_table(spark, path, schema, keys), compacted, 0, partition_by)
