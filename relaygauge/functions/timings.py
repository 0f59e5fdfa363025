"""Timing marks of a latency record and the pairs they form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def timings_from_map(timings: Column) -> Column:
    """Map-shaped timings as an array of (key, value), earliest mark first."""
    by_time = F.array_sort(
        F.transform(
            F.map_entries(timings),
            lambda mark: F.struct(mark["value"].alias("value"), mark["key"].alias("key")),
        )
    )
    return F.transform(
        by_time, lambda mark: F.struct(mark["key"].alias("key"), mark["value"].alias("value"))
    )


def later_marks(timings: Column, marks: Column, place: Column, mark: Column) -> Column:
    """The marks that form a pair with the one at ``place`` (from 0) of the distinct ``marks``.

    Marks form a multiset: equal (key, value) marks count once, in order of first appearance,
    and a mark that is repeated also pairs with itself.  The search for repeats is made only in
    records that have any.
    """
    after = F.slice(marks, place + 2, F.size(marks))
    repeated = F.size(F.filter(timings, lambda other: other.eqNullSafe(mark))) > 1
    return F.when((F.size(marks) < F.size(timings)) & repeated, F.concat(after, F.array(mark))).otherwise(after)
