"""Synthetic datasets: random lines, metric records, budgets, replay."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaygauge.functions.clock import nanos_of_millis
from relaygauge.functions.text import hashed_length, hashed_text, utf8_bytes
from relaygauge.operators.totals import cut_at_budget


@dataclass(frozen=True)
class Shape:
    """Seed and entry lengths of a synthetic dataset."""

    seed: str
    shortest: int
    longest: int

    def __post_init__(self) -> None:
        if not 0 <= self.shortest <= self.longest:
            raise ValueError("lengths must satisfy 0 <= shortest <= longest")


def synthetic_lines(ids: DataFrame, shape: Shape) -> DataFrame:
    """A printable line for each ``id``, its length uniform in the shape's bounds."""
    length = hashed_length(shape.seed, F.col("id"), shape.shortest, shape.longest)
    return ids.select("id", hashed_text(shape.seed, F.col("id"), length).alias("line"))


def line_dataset(spark: SparkSession, budget: int, shape: Shape) -> DataFrame:
    """Lines until the file they fill reaches ``budget`` bytes, line breaks counted.

    The cut is found from the lengths alone; text is made only for the lines kept.
    """
    if budget < 0:
        raise ValueError("the budget is not negative")
    ids = spark.range(budget // (shape.shortest + 1) + 1)
    return synthetic_lines(size_bounded_ids(ids, budget, shape), shape)


def size_bounded_ids(ids: DataFrame, budget: int, shape: Shape) -> DataFrame:
    length = hashed_length(shape.seed, F.col("id"), shape.shortest, shape.longest)
    return cut_at_budget(ids, "id", length + 1, budget)


def metric_records(ids: DataFrame, shape: Shape) -> DataFrame:
    """Metric records for rows (id, created_ms): id 0, one timing, a value of fixed length."""
    length = F.lit(shape.longest - shape.shortest + 1).cast("bigint")
    valued = ids.withColumn("value", utf8_bytes(hashed_text(shape.seed, F.col("id"), length)))
    return valued.select(
        F.lit(0).cast("bigint").alias("id"),
        F.create_map(F.lit("created"), nanos_of_millis(F.col("created_ms"))).alias("timings"),
        "value",
    )


Generator = Callable[[DataFrame, Shape], DataFrame]
_generators: dict[str, Generator] = {"lines": synthetic_lines, "metrics": metric_records}


def register_generator(name: str, generator: Generator) -> None:
    """Add a record generator: column expressions over a table of ids."""
    _generators[name] = generator


def generate(name: str, ids: DataFrame, shape: Shape) -> DataFrame:
    if name not in _generators:
        raise ValueError(f"no generator named {name!r}")
    return _generators[name](ids, shape)


def replay(rows: DataFrame, times: int) -> DataFrame:
    """Every row once per ``round``; rows are copied where they lie."""
    if times < 1:
        raise ValueError("a replay has at least one round")
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("round"))
