"""A synthetic dataset on a topic: lines up to a size, numbered by partition and offset."""

from __future__ import annotations

from pyspark.sql import DataFrame

from relaygauge.operators.lines import lines_to_messages
from relaygauge.operators.synthetic import Shape, size_bounded_ids, synthetic_lines


def dataset_topic(ids: DataFrame, budget: int, shape: Shape, topic: str, partitions: int) -> DataFrame:
    """Topic rows of a line for each ``id``, as long as the lines before it stay below ``budget``
    bytes."""
    lines = synthetic_lines(size_bounded_ids(ids, budget, shape), shape)
    return lines_to_messages(lines, "id", "line", topic, partitions)
