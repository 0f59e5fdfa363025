"""Datasets of text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of UTF-8 text files as ``line``."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.text(path).withColumnRenamed("value", "line")
