"""Running totals and budget cuts over tables of any size.

A window over a whole topic would put all of it in one task.  Here the order is cut into
buckets of bounded width: totals per bucket are summed up first (few rows), and only then
do the rows of each bucket continue from the total before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Widths of the buckets of a whole-number order, finest first, as powers of two.
BUCKET_BITS = (15, 27)
# Bits by which a search narrows the range of an order down at a time.
STEP_BITS = 14


def whole_number_levels(
    number: Column, outer: Sequence[Column] = (), bits: Sequence[int] = BUCKET_BITS
) -> list[list[Column]]:
    """Bucket columns for rows ordered by ``outer`` and then by a whole number."""
    return [[*outer, F.shiftright(number, b)] for b in bits]


def _continue_from(
    rows: DataFrame, base: DataFrame | None, within: list[str], order: list[str], value: str, total: str
) -> DataFrame:
    """Inclusive running sum of ``value``; ``base`` brings the total before each bucket as one
    extra row that sorts first, so no join and no broadcast is needed."""
    frame = W.partitionBy(*within).rowsBetween(W.unboundedPreceding, W.currentRow)
    if base is None:
        return rows.withColumn(total, F.sum(value).over(frame.orderBy(*order)))
    carried = base.select(*within, F.col("_before").alias(value), F.lit(0).alias("_row"))
    both = rows.withColumn("_row", F.lit(1)).unionByName(carried, allowMissingColumns=True)
    summed = both.withColumn(total, F.sum(value).over(frame.orderBy("_row", *order)))
    return summed.where("_row = 1").drop("_row")


def bucket_names(levels: Sequence[Sequence[Column]]) -> list[list[str]]:
    """The columns that the operators below name the buckets of each level by."""
    return [[f"_bucket{i}_{j}" for j in range(len(level))] for i, level in enumerate(levels)]


def _located(rows: DataFrame, levels: Sequence[Sequence[Column]], value: Column) -> DataFrame:
    named = {n: c for names, level in zip(bucket_names(levels), levels) for n, c in zip(names, level)}
    columns = {n: c for n, c in named.items() if n not in rows.columns}
    return rows.withColumns(columns).withColumn("_value", value.cast("bigint"))


def bucket_totals(
    rows: DataFrame, keys: Sequence[str], levels: Sequence[Sequence[Column]], value: Column
) -> DataFrame:
    """One row per key and finest bucket: the total ``_before`` it and its own ``_sum``."""
    keys, names = list(keys), bucket_names(levels)
    sums = []
    source = _located(rows, levels, value)
    for i in range(len(names)):
        source = source.groupBy(*keys, *[n for level in names[i:] for n in level]).agg(
            F.sum("_value").alias("_value")
        )
        sums.append(source)

    base = None
    for i in reversed(range(len(names))):
        within = keys + (names[i + 1] if i + 1 < len(names) else [])
        running = _continue_from(sums[i], base, within, names[i], "_value", "_running")
        base = running.select(
            *keys, *names[i], (F.col("_running") - F.col("_value")).alias("_before"), F.col("_value").alias("_sum")
        )
    return base


def continued_total(
    rows: DataFrame,
    bases: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    levels: Sequence[Sequence[Column]],
    value: Column,
    total: str,
) -> tuple[DataFrame, list[str]]:
    """``rows`` with their inclusive running sum, continued from ``bases`` (``bucket_totals``),
    and the names of the finest bucket columns, by which the result is hash partitioned.

    ``rows`` may be fewer than those the bases were made of, if they hold whole buckets.
    """
    finest = bucket_names(levels)[0]
    located = _located(rows, levels[:1], value)
    within = list(keys) + finest
    return _continue_from(located, bases, within, list(order), "_value", total).drop("_value"), finest


def bucketed_total(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    levels: Sequence[Sequence[Column]],
    value: Column,
    total: str,
) -> tuple[DataFrame, list[str]]:
    """``rows`` with the inclusive running sum of ``value`` per ``keys`` in ``order``, and the
    names of the finest bucket columns, by which the result is hash partitioned.

    ``levels`` lists bucket columns, finest first.  Each must rise with ``order`` and be fixed
    by the level before it; no two rows of one key may be equal in ``order``.
    """
    bases = bucket_totals(rows, keys, levels, value)
    return continued_total(rows, bases, keys, order, levels, value, total)


def running_total(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    levels: Sequence[Sequence[Column]],
    value: Column,
    total: str = "total",
) -> DataFrame:
    """``rows`` with the inclusive running sum of ``value`` per ``keys`` in ``order``."""
    counted, buckets = bucketed_total(rows, keys, order, levels, value, total)
    return counted.drop(*buckets)


def cut_at_budget(rows: DataFrame, order: str, size: Column, budget: int) -> DataFrame:
    """The first rows by a whole-number ``order`` whose preceding sizes stay below ``budget``.

    The last row kept may overshoot the budget, by less than its own size.  Rows are never
    shuffled: totals per bucket tell which bucket holds the cut, a running sum inside that one
    bucket finds it, and the scan then filters on a plain bound.  The range of ``order`` says how
    often buckets are divided, so that each step has STEP_BITS bits of parts whatever numbers are used.
    """
    low, high = rows.agg(F.min(order), F.max(order)).first()
    if low is None:
        return rows
    sized = rows.select(F.col(order).alias("_at"), size.cast("bigint").alias("_value"))
    spent = F.lit(0).cast("bigint")
    # Each window below sees the parts of one bucket only, so one task is enough.
    for bits in reversed(range(STEP_BITS, (high - low).bit_length(), STEP_BITS)):
        bucket = F.shiftright(F.col("_at"), bits)
        sums = sized.groupBy(bucket.alias("_at")).agg(F.sum("_value").alias("_value"))
        last = _last_below(sums, spent, budget)
        sized = sized.where(bucket == last["_at"])
        spent = last["_before"]
    return rows.where(F.col(order) <= _last_below(sized, spent, budget)["_at"])


def _last_below(parts: DataFrame, spent: Column, budget: int) -> Column:
    """The last part, as a scalar (_at, _before), with less than ``budget`` before it."""
    earlier = W.orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_value").over(earlier), F.lit(0)) + spent
    opened = parts.select("_at", before.alias("_before")).where(F.col("_before") < budget)
    return opened.agg(F.max(F.struct("_at", "_before"))).scalar()
