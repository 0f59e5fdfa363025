"""Where two topics differ: the first message by descent, and which slices meet again by their content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from relaygauge.operators import alignment, trees
from relaygauge.operators.positions import SLICE_SIZE
from relaygauge.session import shared_folder


def _store(frame: DataFrame, folder: str | None, purpose: str) -> Callable[[DataFrame, str], DataFrame]:
    spark, root = frame.sparkSession, folder or shared_folder(frame.sparkSession, purpose)

    def stored(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{root}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{root}/{name}")

    return stored


def first_differences(
    nodes: DataFrame, messages: DataFrame, tests: DataFrame, folder: str | None = None, leaf_bits: int = trees.LEAF_BITS
) -> DataFrame:
    """The first message of each test in which its topics differ, by descent of their trees of digests.

    ``nodes`` are those of ``tree_nodes``, stored, and added up if they are of several batches.  One branch per test is
    followed: of each level only the nodes below the one that was opened are compared, and of ``messages``
    only those of one leaf per test are read.  Offsets of both topics must be the same, as a relay
    that keeps them writes.
    """
    stored = _store(nodes, folder, "descent")
    opened = trees.first_differing(nodes.where(f"level = {trees.LEVELS}"), tests)
    for level in range(trees.LEVELS - 1, -1, -1):
        opened = stored(opened, f"level{level + 1}")
        opened = trees.first_differing(trees.children(nodes, opened, level), tests)
    leaves = stored(opened, "leaves")
    return trees.first_differences_in(leaves, messages, tests, leaf_bits)


def compare_by_content(
    messages: DataFrame, tests: DataFrame, slice_size: int = SLICE_SIZE, folder: str | None = None
) -> DataFrame:
    """One row per test: how many slices by content each topic has, how many the other lacks, and seams.

    A lost, added or changed message touches one slice or two, where the verdict by place reports all slices
    behind it as different.  Prints and slices are written below ``folder``, so each is made once;
    payloads stay where they lie.
    """
    stored = _store(messages, folder, "alignment")
    prints = stored(alignment.content_prints(messages, slice_size), "prints")
    sliced = stored(alignment.slice_starts(prints), "sliced")
    slices = stored(alignment.content_slices(sliced), "slices")
    aligned = stored(alignment.align_slices(slices, tests), "aligned")
    return alignment.alignment_report(aligned, tests)
