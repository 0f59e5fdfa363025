"""Running totals and budget cuts against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from relaygauge.operators import positions, totals
from relaygauge.operators.synthetic import Shape, line_dataset, replay
from relaygauge.schemas import MESSAGE


def offsets(kind):
    wide = 1 << 29
    if kind == "sparse":
        return random.Random(3).sample(range(wide), 400)
    if kind == "edges":
        edges = [1 << 15, 1 << 16, 1 << 27, 1 << 28, wide]
        return sorted({max(0, e + d) for e in edges for d in (-2, -1, 0, 1, 2)})
    return range(1000)


@pytest.mark.parametrize("kind", ["sparse", "edges", "dense"])
def test_positions_equal_a_sort(spark, kind):
    # One partition holds most rows, as a topic of one partition would.
    keys = [(0, o) for o in offsets(kind)] + [(p, o) for p in (1, 2) for o in (0, 5, 1 << 27)]
    random.Random(1).shuffle(keys)
    rows = [("t", "src", p, o, "") for p, o in keys]
    got = positions.message_positions(spark.createDataFrame(rows, MESSAGE)).collect()
    assert {(r.partition, r.offset): r.position for r in got} == {k: i + 1 for i, k in enumerate(sorted(keys))}


def test_running_total_of_values(spark):
    values = {o: random.Random(o).randrange(-50, 100) for o in offsets("sparse")}
    rows = spark.createDataFrame([(g, o, v) for g in ("a", "b") for o, v in values.items()], "g STRING, o BIGINT, v BIGINT")
    got = totals.running_total(rows, ["g"], ["o"], totals.whole_number_levels(F.col("o")), F.col("v"))
    expected, total = {}, 0
    for o in sorted(values):
        total += values[o]
        expected[o] = total
    assert {(r.g, r.o): r.total for r in got.collect()} == {(g, o): t for g in ("a", "b") for o, t in expected.items()}


@pytest.mark.parametrize("budget", [0, 1, 57, 3000, 10**9])
@pytest.mark.parametrize("kind", ["sparse", "edges"])
def test_cut_equals_a_loop(spark, kind, budget):
    sizes = {o: 1 + o % 97 for o in offsets(kind)}
    rows = spark.createDataFrame(list(sizes.items()), "o BIGINT, n BIGINT")
    kept, spent = [], 0
    for o in sorted(sizes):
        if spent < budget:
            kept.append(o)
            spent += sizes[o]
    got = totals.cut_at_budget(rows, "o", F.col("n"), budget)
    assert sorted(r.o for r in got.collect()) == kept


def test_dataset_meets_its_budget(spark):
    shape, budget = Shape("s", 5, 40), 20_000
    lines = [r.line for r in line_dataset(spark, budget, shape).collect()]
    size = sum(len(line.encode()) + 1 for line in lines)
    assert budget <= size < budget + 41
    assert min(map(len, lines)) == 5 and max(map(len, lines)) == 40
    assert len(set(lines)) > 0.95 * len(lines)


def test_fixed_and_zero_lengths(spark):
    assert [r.line for r in line_dataset(spark, 3, Shape("s", 0, 0)).collect()] == ["", "", ""]
    with pytest.raises(ValueError):
        Shape("s", 5, 4)


def test_replay(spark):
    assert sorted((r.id, r.round) for r in replay(spark.range(2), 2).collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]
