"""Timing pairs, buckets and rolling windows against plain Python."""

import itertools
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from relaygauge.functions.timings import timings_from_map
from relaygauge.operators import latencies, rolling, series
from relaygauge.schemas import LATENCY_EVENT, LATENCY_RECORD

AT = datetime(2024, 1, 1, tzinfo=timezone.utc)
TAG = {"topic": "t", "partition": "0", "consumerId": "c"}


def records(spark, rows):
    return spark.createDataFrame([(tag, timings, AT) for tag, timings in rows], LATENCY_RECORD)


def pairs(spark, timings):
    got = latencies.latency_pairs(records(spark, [(TAG, timings)])).collect()
    return sorted((r.eventname, r.latency) for r in got)


def test_pairs_of_a_multiset(spark):
    assert pairs(spark, []) == []
    assert pairs(spark, None) == []
    assert pairs(spark, [("a", 1)]) == []
    assert pairs(spark, [("a", 1), ("b", 5)]) == [("a-b", 4)]
    assert pairs(spark, [("b", 5), ("a", 1)]) == [("b-a", -4)]
    assert pairs(spark, [("b", 2), ("a", 1), ("b", 2), ("c", 9)]) == [("a-c", 8), ("b-a", -1), ("b-b", 0), ("b-c", 7)]
    assert pairs(spark, [("a", 1), ("a", 1)]) == [("a-a", 0)]
    assert pairs(spark, [("a", 1), ("a", 1), ("a", 1)]) == [("a-a", 0)]
    assert pairs(spark, [("a", 1), ("a", 4)]) == [("a-a", 3)]


def test_pairs_of_many_marks(spark):
    marks = [(f"k{i}", i * i) for i in range(8)]
    expected = sorted((f"{a}-{b}", y - x) for (a, x), (b, y) in itertools.combinations(marks, 2))
    assert pairs(spark, marks) == expected


def test_missing_tags_are_set_aside(spark):
    rows = [(TAG, [("a", 1), ("b", 2)]), ({"topic": "t", "partition": "0"}, []), (None, []), ({}, [])]
    frame = records(spark, rows)
    assert latencies.complete_records(frame).count() == 1
    assert sorted(r.missing_tag for r in latencies.incomplete_records(frame).collect()) == ["consumerId", "topic", "topic"]
    assert latencies.latency_buckets(frame).count() == 1


def test_map_timings(spark):
    frame = spark.createDataFrame([({"b": 1, "a": 7, "c": 3},), (None,)], "m MAP<STRING, BIGINT>")
    got = [r[0] for r in frame.select(timings_from_map(F.col("m"))).collect()]
    assert [(m.key, m.value) for m in got[0]] == [("b", 1), ("c", 3), ("a", 7)] and got[1] is None


def test_negative_averages_truncate_toward_zero(spark):
    frame = spark.createDataFrame([("t", "0", "c", "a-b", 100, -7, 2)], BUCKET)
    assert {r.value for r in rolling.rolling_averages(frame, [("second", 10)]).collect()} == {-3}


BUCKET = "topic STRING, partition STRING, consumerid STRING, eventname STRING, second BIGINT, total BIGINT, cnt BIGINT"


def brute(buckets, span, every, label):
    windows = {}
    for name, second, total, cnt in buckets:
        for end in range(second + 1, second + span + 1):
            if end % every == 0:
                t, c = windows.get((name, end), (0, 0))
                windows[(name, end)] = (t + total, c + cnt)
    return {(name, end, label, int(t / c), c) for (name, end), (t, c) in windows.items()}


@pytest.fixture(scope="module")
def buckets(spark):
    pick = random.Random(5)
    seconds = sorted(pick.sample(range(3000), 120)) + [3599, 3600, 3601, 7199, 7200, 9000]
    rows = [(name, s, pick.randrange(-900, 900), pick.randrange(1, 4)) for name in ("x", "y") for s in seconds]
    frame = spark.createDataFrame([("t", "0", "c", n, s, t, c) for n, s, t, c in rows], BUCKET)
    return rows, frame.cache()


@pytest.mark.parametrize(("unit", "length", "every"), [("second", 10, 1), ("second", 30, 7), ("minute", 1, 60), ("minute", 15, 60)])
def test_rolling_equals_expansion(buckets, unit, length, every):
    rows, frame = buckets
    span = length * (60 if unit == "minute" else 1)
    got = rolling.rolling_averages(frame, [(unit, length)], every, block_seconds=1000)
    mine = [(r.eventname, r.second, r.operation, r.value, r.cnt) for r in got.collect()]
    assert len(mine) == len(set(mine))
    assert set(mine) == brute(rows, span, every, f"avg{length}{unit}")


def test_spans_hold_every_window(buckets):
    rows, frame = buckets
    spans = rolling.rolling_spans(frame, [("minute", 15)], block_seconds=1000).collect()
    got = {(r.eventname, s, r.operation, r.value, r.cnt) for r in spans for s in range(r["from"], r.until)}
    assert got == brute(rows, 900, 1, "avg15minute") and len(spans) < 3 * len(rows)
    assert sum(r.until - r["from"] for r in spans) == len(got)


def test_all_windows_at_once(buckets):
    rows, frame = buckets
    got = rolling.rolling_averages(frame, emit_every=60)
    expected = set()
    for unit, length in rolling.WINDOWS:
        expected |= brute(rows, length * (60 if unit == "minute" else 1), 60, f"avg{length}{unit}")
    assert {(r.eventname, r.second, r.operation, r.value, r.cnt) for r in got.collect()} == expected


def test_native_windows_agree(buckets):
    _, frame = buckets
    one = rolling.rolling_averages(frame, [("second", 30)])
    two = rolling.native_rolling_averages(frame, "second", 30).select(one.columns)
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_native_windows_are_dealt_out_to_tasks(buckets):
    """No task has more windows than its share, before or behind the shuffle."""
    _, frame = buckets
    one = rolling.rolling_averages(frame, [("second", 30)])
    two = rolling.native_rolling_averages(frame, "second", 30, tasks=9).select(one.columns)
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
    assert two.rdd.getNumPartitions() == 9
    # Before it runs, the plan is there once; the buckets here are given, so the one exchange deals out their copies.
    plan = rolling.native_rolling_averages(frame, "second", 30, tasks=9)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.rindex("HashAggregate") < plan.index("Exchange ")


def test_invalid_windows(buckets):
    _, frame = buckets
    for call in (
        lambda: rolling.rolling_averages(frame, [("hour", 1)]),
        lambda: rolling.rolling_averages(frame, [("minute", 15)], block_seconds=60),
        lambda: rolling.rolling_averages(frame, emit_every=0),
    ):
        with pytest.raises(ValueError):
            call()


def test_series(spark):
    rows = [
        ("t", "0", "c", "a-b", 7201, "avg10second", 5, 2),
        ("t", "0", "c", "a-b", 3599, "avg10second", 9, 1),
        ("t", "0", "c", "a-c", 3598, "avg10second", 1, 3),
        ("t", "1", "c", "a-b", 3597, "avg1minute", 100, 100),
    ]
    events = spark.createDataFrame(rows, LATENCY_EVENT)
    charted = series.chart_events(events)
    assert charted.count() == 3
    assert series.series_long(charted).count() == 6
    apart = series.series_points(charted.union(charted.withColumn("topic", F.lit("u"))))
    assert apart.count() == 2 * series.series_points(charted).count()
    merged = series.series_points(charted, merge_eventnames=True).where("field = 'value'")
    assert {(r.hour, tuple(p.y for p in r.points)) for r in merged.collect()} == {(0, (1, 9)), (7200, (5,))}
    extent = {r.field: (r.first_second, r.last_second, r.lowest, r.highest) for r in series.series_extent(charted).collect()}
    assert extent == {"value": (3598, 7201, 1, 9), "count": (3598, 7201, 1, 3)}
    recent = series.events_history(events, "t", 7300).collect()
    assert [r.second for r in recent] == [7201]


SPAN = 'topic STRING, partition STRING, consumerid STRING, eventname STRING, operation STRING, "from" BIGINT, until BIGINT, value BIGINT, cnt BIGINT, batch_id BIGINT'.replace('"', "`")


def test_spans_of_versions_merge_as_their_seconds_do(spark):
    """Equal, touching, nested and crossing spans, some over the edges of blocks."""
    pick = random.Random(7)
    rows, newest, often = [], {}, {}
    edge = 3 * rolling.BLOCK_SECONDS
    for batch in range(6):
        at = {"a": edge - 200, "b": edge - 50, "c": 5}
        for name, second in at.items():
            while second < at[name] + 400:
                until = second + pick.choice([1, 3, 40])
                value = pick.randrange(3)
                if pick.random() < 0.7:
                    rows.append(("t", "0", "c", name, "avg10second", second, until, value, 1, batch))
                    for s in range(second, until):
                        newest[name, s] = (value, batch)
                        often[name, s, value] = often.get((name, s, value), 0) + 1
                second = until
    frame = spark.createDataFrame(rows + [("t", "0", "c", "whole", "avg10second", edge, edge + 90, 1, 1, b) for b in (1, 2)], SPAN)
    merged = rolling.newest_spans(frame, "batch_id")
    assert merged.columns == frame.columns
    # Versions that agree about the bounds are not unfolded.
    assert [(r["from"], r.until, r.batch_id) for r in merged.where("eventname = 'whole'").collect()] == [(edge, edge + 90, 2)]
    got = rolling.unfold_spans(merged.where("eventname <> 'whole'"), keep=["batch_id"]).collect()
    assert len(got) == len(newest) and {(r.eventname, r.second): (r.value, r.batch_id) for r in got} == newest
    counted = rolling.unfold_spans(rolling.counted_spans(frame.where("eventname <> 'whole'"), "n"), keep=["n"]).collect()
    assert len(counted) == len(often) and {(r.eventname, r.second, r.value): r.n for r in counted} == often


def test_rolling_rows_sort_by_a_number_first(buckets):
    """Not by texts, which nearly all rows of a task share."""
    _, frame = buckets
    plan = rolling.rolling_spans(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Sort [_group#" in plan and "Sort [topic#" not in plan
