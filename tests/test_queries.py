"""Each registered query against its SQL on the smallest tables."""

import json

import pytest
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

import __spark_entry__ as entry
from relaygauge.checks import queries
from relaygauge.checks.compare import differences
from relaygauge.checks.oracles import ORACLES
from relaygauge.checks.queries import QUERIES
from relaygauge.schemas import LATENCY_EVENT
from relaygauge.sinks.topics import event_values
from relaygauge.sources.results import decode_reports, reported_once

FOLDER = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, name):
    rows, difference = differences(spark, name, FOLDER)
    assert difference is None
    assert rows > 0


def test_entry_gives_a_report(spark):
    report = {row.test_id: row for row in entry.entry(spark).collect()}
    assert report["faithful"].same_amount and report["faithful"].order_preserved
    assert not report["dropped"].same_amount and not report["dropped"].order_preserved
    assert report["edited"].same_amount and not report["edited"].order_preserved
    assert report["absent"].status == "NO_SUCH_TEST"


def test_reports_are_dealt_out_by_the_number_of_events(spark, monkeypatch):
    """1,000 events: a task for each hundred of them compares keys twice over, whatever the bytes that cross the shuffle."""
    monkeypatch.setattr(queries, "REPORT_TASK_ROWS", 100)
    reports = QUERIES["report_feed"](spark, FOLDER)
    assert reports.rdd.getNumPartitions() == 2 * spark.read.parquet(f"{FOLDER}/events.parquet").count() // 100
    rows, difference = differences(spark, "report_feed", FOLDER)
    assert difference is None and rows > 0


def test_event_values_are_the_json_as_utf8(spark):
    row = ('a"\\\nü ', "0", "\U0001f600", "x-y", 5, "avg10second", -3, 1)
    events = spark.createDataFrame([row], LATENCY_EVENT)
    (value,) = event_values(events, "t", 7).collect()
    assert json.loads(bytes(value.value).decode())["topic"] == row[0]
    (back,) = decode_reports(event_values(events, "t", 7)).collect()
    assert tuple(back)[:-1] == (*row, 7)


def test_dealt_out_reports_are_the_same(spark):
    """Seconds around the ends of minutes and below 0; a key with another batch or mark is another report."""
    rows = [("t", "0", "0", e, s, "avg10second", 1, 1, b, None) for e in "xy" for s in (-61, -60, -1, 0, 59, 60) for b in (0, 2)]
    reports = spark.createDataFrame(rows * 2, StructType([*LATENCY_EVENT.fields, StructField("batch", LongType()), StructField("reported", TimestampType())]))
    dealt = reported_once(reports, "10 minutes", 3)
    assert dealt.columns == reports.columns and dealt.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, dealt.collect()), key=str) == sorted(rows, key=str)
    assert sorted(map(tuple, reported_once(reports, "10 minutes").collect()), key=str) == sorted(rows, key=str)
