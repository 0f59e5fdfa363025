"""Mixing sources to target weights: whole passes over a source, and an exact fit of the rest."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relaygauge.llm.frames import VISIBLE_SPLIT, stage

MAX_REPEATS = 3  # fixed value: no source and no document counts more often
GROUP_ROWS = 1024  # documents of one source and length that are ranked together
TABLE_WORDS = 1 << 16  # entries of the subset sum's table, each of one word or of a coarser unit
POOL = 32  # documents of a source of which every choice is tried where the subset sum is not exact
SEED = 17


def shared_targets(totals: pd.DataFrame, repeats: float = MAX_REPEATS) -> np.ndarray:
    """Targets of sources with ``size`` and ``weight`` that add up to all sizes.

    A target stops at ``repeats`` times its source's size; the excess goes to the others by weight
    until none is above.
    """
    sizes, weights = totals["size"].to_numpy(float), totals["weight"].to_numpy(float)
    targets, open_, left = np.zeros(len(sizes)), np.ones(len(sizes), bool), sizes.sum()
    while open_.any():
        share = np.where(open_, left * weights / weights[open_].sum(), targets)
        over = open_ & (share > repeats * sizes)
        if not over.any():
            return share
        targets[over] = repeats * sizes[over]
        left -= targets[over].sum()
        open_ &= ~over
    return targets


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: int, seed: int, table: int = TABLE_WORDS) -> np.ndarray:
    """How many documents of each size to take, so that the words come as near ``budget`` as can be.

    Counts are first taken in proportion, which leaves a remainder; a bounded knapsack over the
    remaining budget then settles it from what is left of each size.  A remainder of more than ``table``
    words is first fitted in coarser units, as large as it takes to come by with a table of that size, and
    finer ones in each turn.  Where that is not exact, as with few long documents, POOL documents are
    chosen anew.
    """
    take = np.zeros(len(sizes), np.int64)
    total = int((sizes * counts).sum())
    if budget <= 0 or total == 0:
        return take
    if budget >= total:
        return counts.copy()
    # A little less than the share, so that the subset sum has room below the budget.
    room = min(table // 2, budget)
    take[:] = np.floor(counts * ((budget - room) / total)).astype(np.int64)
    rest = budget - int((take * sizes).sum())
    # Sizes are tried in a seeded order, so that long documents do not come before short ones.
    order = np.random.default_rng(seed).permutation(len(sizes))
    while rest > table:
        # Room is left for the exact sum where there are documents that it can take.
        spare = counts - take
        aim = rest - table // 2 if ((spare > 0) & (sizes > 0) & (sizes <= table // 2)).any() else rest
        step = -(-aim // table)
        more = _subset_sum(-(-sizes // step), spare, aim // step, order)
        if not more.any():
            break
        take += more
        rest -= int((more * sizes).sum())
    if 0 <= rest <= table:
        take += _subset_sum(sizes, counts - take, rest)
    if int((take * sizes).sum()) != budget:
        take = _exchanged(sizes, counts, take, budget, seed)
    return take


def _exchanged(sizes: np.ndarray, counts: np.ndarray, take: np.ndarray, budget: int, seed: int) -> np.ndarray:
    """``take`` or, if that comes nearer ``budget``, the best of all choices among POOL of its documents.

    Of documents taken and not taken, as many of each as there are up to POOL together, every set is
    tried: sums of one half of them, sorted, are searched for what each sum of the other half lacks.
    """
    order = np.random.default_rng(seed).permutation(np.flatnonzero(sizes > 0))

    def some(have: np.ndarray, n: int) -> list[int]:
        found: list[int] = []
        turn = 0
        while len(found) < n and (more := [int(k) for k in order if have[k] > turn]):
            found += more[: n - len(found)]
            turn += 1
        return found

    mine, theirs = some(take, POOL), some(counts - take, POOL)
    n = min(len(mine), max(POOL // 2, POOL - len(theirs)))
    pool = mine[:n] + theirs[: POOL - n]
    base = take.copy()
    np.subtract.at(base, mine[:n], 1)
    halves = [pool[::2], pool[1::2]]
    sums = []
    for half in halves:
        total = np.zeros(1, np.int64)
        for k in half:
            total = np.concatenate([total, total + int(sizes[k])])
        sums.append(total)
    by = np.argsort(sums[1], kind="stable")
    lack = budget - int((base * sizes).sum()) - sums[0]
    at = np.searchsorted(sums[1][by], lack)
    near = np.stack([np.maximum(at - 1, 0), np.minimum(at, len(by) - 1)])
    off = np.abs(sums[1][by][near] - lack)
    side, first = np.unravel_index(int(off.argmin()), off.shape)
    if off[side, first] >= abs(budget - int((take * sizes).sum())):
        return take
    for half, bits in zip(halves, (int(first), int(by[near[side, first]]))):
        for i, k in enumerate(half):
            base[k] += bits >> i & 1
    return base


def _subset_sum(sizes: np.ndarray, spare: np.ndarray, budget: int, order: np.ndarray | None = None) -> np.ndarray:
    """Bounded knapsack: numbers per size whose words come nearest to ``budget``, above or below.

    Sizes come in ``order``, or the largest first.
    """
    order = np.argsort(-sizes, kind="stable") if order is None else order
    usable = [int(k) for k in order if spare[k] > 0 and 0 < sizes[k]]
    limit = budget + (min(int(sizes[k]) for k in usable) if usable else 0)
    reached = np.zeros(limit + 1, bool)
    reached[0] = True
    how = np.full(limit + 1, -1, np.int32)  # the part that first reached this sum
    parts: list[tuple[int, int]] = []
    for k in usable:
        size, left, step = int(sizes[k]), int(min(spare[k], limit // int(sizes[k]))), 1
        while left > 0:  # a count is a sum of powers of two and a rest, each taken once
            n = min(step, left)
            left, step = left - n, step * 2
            grown = np.zeros(limit + 1, bool)
            grown[n * size :] = reached[: limit + 1 - n * size]
            new = grown & ~reached
            how[new] = len(parts)
            reached |= new
            parts.append((k, n))
        if reached[budget]:
            break
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    taken = np.zeros(len(sizes), np.int64)
    while at > 0:  # the part that first reached a sum came from a sum reached without it
        k, n = parts[how[at]]
        taken[k] += n
        at -= n * int(sizes[k])
    return taken


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (1, 2, 3),
    repeats: int = MAX_REPEATS,
    seed: int = SEED,
    text: str = "text",
    key: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """(``key``, source, size, source_size, target, copies, taken) for each row of ``docs``.

    Sources in code-point order, null last, get ``weights`` in turn; targets are their shares of
    all words, capped at ``repeats`` times the source.  A source is taken whole as often as it fits
    in its target; for the rest, documents are counted by exact length, a subset sum says how many
    of each length to add, and seeded hashes choose which.  A null text has size 0; repeated rows are
    documents of their own; an empty table gives no rows; other columns are not read.

    Only (source, length, count) rows are gathered, one group per source; documents are ranked in
    groups of about GROUP_ROWS, however many share a source and a length.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.size(F.filter(F.split(whole, VISIBLE_SPLIT), lambda w: w != ""))
    sized = stage(
        docs.select(
            F.col(key).alias("_key"),
            F.col(source).cast("string").alias("_source"),
            words.cast("long").alias("_size"),
            F.xxhash64(F.lit(seed), F.col(key), whole).alias("_hash"),
        ),
        "mixing",
    )
    lengths = sized.groupBy("_source", "_size").agg(F.count(F.lit(1)).alias("_n"))
    totals = lengths.groupBy("_source").agg(F.sum(F.col("_size") * F.col("_n")).alias("size"))
    table = totals.toPandas()  # a row per source
    table = table.assign(_null=table["_source"].isna()).sort_values(["_null", "_source"]).reset_index(drop=True)
    table["weight"] = [float(weights[i % len(weights)]) for i in range(len(table))]
    table["target"] = shared_targets(table, repeats)
    targets = docs.sparkSession.createDataFrame(
        [
            (name if isinstance(name, str) else None, int(size), float(target))
            for name, size, target in zip(table["_source"], table["size"], table["target"])
        ],
        "_source string, _source_size long, _target double",
    )

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_size", kind="stable").reset_index(drop=True)
        sizes, counts = rows["_size"].to_numpy(), rows["_n"].to_numpy()
        total, target = int(rows["_source_size"].iloc[0]), rows["_target"].iloc[0]
        passes = min(int(target // total), repeats) if total else 0
        more = fit_counts(sizes, counts, int(round(target - passes * total)), seed) if passes < repeats else 0 * counts
        return rows.assign(_passes=passes, _more=more)[[*rows.columns, "_passes", "_more"]]

    # Null-safe: the sources' own rows carry their target to the lengths.
    joined = lengths.join(targets, lengths["_source"].eqNullSafe(targets["_source"])).select(
        lengths["_source"], "_size", "_n", "_source_size", "_target"
    )
    plan = joined.groupBy("_source").applyInPandas(
        fit, "_source string, _size long, _n long, _source_size long, _target double, _passes long, _more long"
    )
    # Documents of one source and length fall into groups by their seeded hash; groups before the
    # one that holds the cut are taken whole, and only there does a rank decide.
    placed = (
        sized.alias("d")
        .join(plan.alias("p"), F.col("d._source").eqNullSafe(F.col("p._source")) & (F.col("d._size") == F.col("p._size")))
        .select("_key", "d._source", "d._size", "_hash", "_n", "_source_size", "_target", "_passes", "_more")
        .withColumn("_groups", F.ceil(F.col("_n") / GROUP_ROWS))
        .withColumn("_group", F.pmod(F.shiftright("_hash", 3), F.col("_groups")))
    )
    group = ["_source", "_size", "_group"]
    before = F.coalesce(
        F.sum("_in").over(W.partitionBy("_source", "_size").orderBy("_group").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    starts = placed.groupBy(*group).agg(F.count(F.lit(1)).alias("_in")).withColumn("_before", before)
    ranked = placed.alias("d").join(
        starts.alias("s"),
        F.col("d._source").eqNullSafe(F.col("s._source"))
        & (F.col("d._size") == F.col("s._size"))
        & (F.col("d._group") == F.col("s._group")),
    ).select("d.*", "_before")
    rank = F.row_number().over(W.partitionBy(*group).orderBy("_hash", F.col("_key").asc_nulls_last()))
    copies = F.col("_passes") + (F.col("_before") + rank <= F.col("_more")).cast("long")
    return ranked.withColumn("copies", copies).select(
        F.col("_key").alias(key),
        F.col("_source").alias(source),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        "copies",
        (F.col("copies") * F.col("_size")).alias("taken"),
    )
