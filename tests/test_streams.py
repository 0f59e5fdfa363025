"""Streams against batches: same results, also after a restart and a repeated batch."""

import shutil
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from relaygauge.operators.archive import marker_values, register_tests, topic_counts
from relaygauge.operators.latencies import latency_buckets
from relaygauge.operators.rolling import rolling_averages
from relaygauge.plans import relay
from relaygauge.plans.relay import MarkerListener, all_ended, check_relay
from relaygauge.schemas import LATENCY_RECORD, TOPIC
from relaygauge.sources.topics import stream_topic
from relaygauge.streaming import DRAIN
from relaygauge.streaming.archive import archive_stream, read_counters, read_messages, read_progress
from relaygauge.streaming.feed import feed_stream
from relaygauge.streaming.replay import by_time, replay_stream, replay_to_topic
from relaygauge.streaming.latency import (
    buckets_table,
    clock_ticks,
    close_windows,
    events_table,
    latency_stream,
    read_buckets,
    read_events,
    read_report_counts,
    read_reports,
)

START = datetime(2024, 1, 1, 23, 50, tzinfo=timezone.utc)
WINDOWS = [("second", 10), ("minute", 1)]


def record(second, k):
    at = START + timedelta(seconds=second, microseconds=k)
    tag = {"topic": "t" if k % 3 else "u", "partition": str(k % 2), "consumerId": "c"}
    return (tag, [("created", 10 * k), ("done", 10 * k + second - 40)], at)


@pytest.fixture
def drops(spark, tmp_path):
    """Four files of records, the third after a pause across midnight."""
    parts = [range(0, 60), range(60, 130), range(1500, 1530), range(1530, 1600)]
    for i, seconds in enumerate(parts):
        rows = [record(s, k) for s in seconds for k in range(1 + s % 3)]
        frame = spark.createDataFrame(rows, LATENCY_RECORD).coalesce(1)
        frame.write.parquet(str(tmp_path / "staged" / str(i)))
    return tmp_path


def deliver(folder, *parts):
    (folder / "in").mkdir(exist_ok=True)
    for part in parts:
        for file in (folder / "staged" / str(part)).glob("part-*"):
            (folder / "in" / f"{part}.parquet").write_bytes(file.read_bytes())


def run(spark, folder, **options):
    stream = spark.readStream.schema(LATENCY_RECORD).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    query = latency_stream(stream, str(folder / "out"), str(folder / "check"), WINDOWS, trigger=DRAIN, **options)
    query.awaitTermination()
    return query


def finish(spark, folder):
    close_windows(spark, str(folder / "out"), WINDOWS)


def expected(spark, folder):
    buckets = latency_buckets(spark.read.schema(LATENCY_RECORD).parquet(str(folder / "in")))
    return buckets, rolling_averages(buckets, WINDOWS)


def same(one, two):
    two = two.select(one.columns)
    return one.count() > 0 and one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_latency_stream_equals_batch_across_restarts(spark, drops):
    deliver(drops, 0, 1)
    run(spark, drops)
    finish(spark, drops)
    closed, events = expected(spark, drops)
    assert same(read_buckets(spark, str(drops / "out")), closed)
    assert same(read_events(spark, str(drops / "out")), events)
    deliver(drops, 2, 3)
    run(spark, drops)  # goes on from its checkpoint
    finish(spark, drops)
    closed, events = expected(spark, drops)
    assert same(read_buckets(spark, str(drops / "out")), closed)
    assert same(read_events(spark, str(drops / "out")), events)


def undo_last_commit(folder):
    """As if the driver had died between the output of the last batch and its commit."""
    last = max((folder / "check" / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)


def test_repeated_batch_leaves_no_double_rows(spark, drops):
    deliver(drops, 0, 1)
    run(spark, drops)
    before = sorted(map(tuple, read_reports(spark, str(drops / "out")).collect()))
    undo_last_commit(drops)
    run(spark, drops)
    assert sorted(map(tuple, read_reports(spark, str(drops / "out")).collect())) == before
    finish(spark, drops)
    assert same(read_events(spark, str(drops / "out")), expected(spark, drops)[1])


@pytest.mark.parametrize("lost", ["events", "frontier"])
def test_a_batch_that_died_halfway_is_completed(spark, drops, lost):
    """The last batch has stored its buckets, but not yet its events, or not yet the frontier."""
    deliver(drops, 0, 1)
    run(spark, drops)
    reports = sorted(map(tuple, read_reports(spark, str(drops / "out")).collect()))
    undo_last_commit(drops)
    if lost == "events":
        manifests = sorted((drops / "out" / "events" / "manifest").glob("v*"))
        manifests[-1].unlink()
        (manifests[-1].parent / f".{manifests[-1].name}.crc").unlink(missing_ok=True)
    frontier = max((drops / "out" / "frontier").glob("[0-9]*"), key=lambda f: int(f.name))
    shutil.rmtree(frontier)
    run(spark, drops)
    assert sorted(map(tuple, read_reports(spark, str(drops / "out")).collect())) == reports


def test_a_lagging_partition_loses_nothing(spark, drops):
    """Records come an hour and more behind the newest, in pieces of the same seconds."""
    for part in (3, 0, 2, 1):
        deliver(drops, part)
        run(spark, drops)
    finish(spark, drops)
    buckets, events = expected(spark, drops)
    assert same(read_buckets(spark, str(drops / "out")), buckets)
    assert same(read_events(spark, str(drops / "out")), events)


def deliver_by_seconds(spark, folder, groups):
    """A file, and so a batch, of records for each group of seconds."""
    for i, seconds in enumerate(groups):
        rows = [record(s, k) for s in seconds for k in range(9)]
        frame = spark.createDataFrame(rows, LATENCY_RECORD).coalesce(1)
        frame.write.mode("append").parquet(str(folder / "in"))


def test_windows_are_reported_once_when_they_have_ended(spark, tmp_path):
    out = str(tmp_path / "out")
    deliver_by_seconds(spark, tmp_path, [range(4 * i, 4 * i + 4) for i in range(6)])
    run(spark, tmp_path)
    reports = read_reports(spark, out)
    newest = read_buckets(spark, out).selectExpr("max(second)").first()[0]
    # Nothing ahead of the records, and no window twice.
    assert reports.selectExpr("max(second)").first()[0] == newest
    assert reports.groupBy("topic", "partition", "eventname", "operation", "second").count().where("count > 1").isEmpty()
    # A row per series, window and second, of which there are 4 series here.
    assert reports.count() == len(WINDOWS) * 4 * 23
    finish(spark, tmp_path)
    assert same(read_events(spark, out), expected(spark, tmp_path)[1])
    assert read_reports(spark, out).count() == read_events(spark, out).count()
    # Closing again finds nothing left.
    finish(spark, tmp_path)
    assert read_reports(spark, out).count() == read_events(spark, out).count()


def test_a_late_record_repeats_the_windows_it_changes(spark, tmp_path):
    out = str(tmp_path / "out")
    deliver_by_seconds(spark, tmp_path, [range(0, 40), range(100, 140), [30], range(140, 150)])
    run(spark, tmp_path)
    finish(spark, tmp_path)
    assert same(read_events(spark, out), expected(spark, tmp_path)[1])
    late = int((START + timedelta(seconds=30)).timestamp())
    often = read_reports(spark, out).groupBy("topic", "partition", "operation", "second").count()
    for operation, span in (("avg10second", 10), ("avg1minute", 60)):
        twice = {r.second - late for r in often.where(f"operation = '{operation}' AND count = 2").collect()}
        assert twice == set(range(1, span + 1))
    assert often.where("count > 2").isEmpty()


def test_stored_reports_do_not_grow_with_the_seconds_of_a_window(spark, tmp_path):
    out = str(tmp_path / "out")
    deliver_by_seconds(spark, tmp_path, [[0, 40], [80, 300]])
    run(spark, tmp_path)
    finish(spark, tmp_path)
    stored = sum(p.rows for p in events_table(spark, out).manifest().parts)
    # A bucket begins and ends a span per window, and a batch cuts one.
    assert stored <= 3 * len(WINDOWS) * read_buckets(spark, out).count() < read_events(spark, out).count()
    assert same(read_events(spark, out), expected(spark, tmp_path)[1])
    counts = read_report_counts(spark, out)
    assert same(counts.drop("reports"), expected(spark, tmp_path)[1]) and counts.where("reports <> 1").isEmpty()


def test_a_silent_series_is_ended_by_the_others(spark, tmp_path):
    """Series of one topic fall silent; those of the other go on and carry the clock."""
    out, rows = str(tmp_path / "out"), []
    for i, seconds in enumerate([range(0, 20), range(20, 60), range(60, 200)]):
        rows = [r for s in seconds for k in range(9) if (r := record(s, k))[0]["topic"] == "t" or s < 20]
        spark.createDataFrame(rows, LATENCY_RECORD).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run(spark, tmp_path, lag=10)
    silent = read_reports(spark, out).where("topic = 'u'")
    whole = expected(spark, tmp_path)[1].where("topic = 'u'")
    assert same(silent.drop("batch_id"), whole)


def test_ticks_end_the_windows_of_a_silent_stream(spark, tmp_path):
    now = datetime.now(timezone.utc).replace(microsecond=0) - timedelta(seconds=80)
    tag = {"topic": "t", "partition": "0", "consumerId": "c"}
    rows = [(tag, [("created", 0), ("done", 5)], now + timedelta(seconds=s)) for s in range(5)]
    spark.createDataFrame(rows, LATENCY_RECORD).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(LATENCY_RECORD).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    query = latency_stream(
        stream, out, str(tmp_path / "check"), WINDOWS, {"processingTime": "1 second"}, lag=1, clock=clock_ticks(spark)
    )
    try:
        whole = rolling_averages(latency_buckets(spark.createDataFrame(rows, LATENCY_RECORD)), WINDOWS).count()
        until = datetime.now() + timedelta(seconds=60)
        while datetime.now() < until and read_reports(spark, out).count() < whole:
            query.awaitTermination(1)
        assert query.exception() is None
    finally:
        query.stop()
    assert read_reports(spark, out).count() == whole


def test_many_batches_leave_few_files(spark, tmp_path):
    deliver_by_seconds(spark, tmp_path, [range(3 * i, 3 * i + 3) for i in range(17)])
    run(spark, tmp_path)
    for table in (buckets_table, events_table):
        parts = table(spark, str(tmp_path / "out")).manifest().parts
        assert [p.level for p in parts] == [1, 0]
    assert len(list((tmp_path / "out" / "frontier").glob("[0-9]*"))) == 3
    finish(spark, tmp_path)
    assert same(read_events(spark, str(tmp_path / "out")), expected(spark, tmp_path)[1])


def test_results_reach_the_topic_and_the_feed(spark, drops):
    deliver(drops, 0)
    topic = str(drops / "topic")
    results = {"topic": "d", "sink_format": "parquet", "path": topic}
    run(spark, drops, results=results)
    close_windows(spark, str(drops / "out"), WINDOWS, results)
    assert spark.read.parquet(topic).count() == read_events(spark, str(drops / "out")).count()
    values = spark.readStream.schema("topic STRING, value BINARY").parquet(topic)
    feed_stream(values, "charts", str(drops / "feedcheck"), "json", str(drops / "feed"), DRAIN).awaitTermination()
    fed = spark.read.json(str(drops / "feed"))
    charted = read_events(spark, str(drops / "out")).where("operation = 'avg10second'")
    assert fed.count() == charted.count() > 0
    assert '"eventName":"created-done"' in fed.first().value and fed.first().topic == "charts"


def test_a_batch_run_twice_shows_once_in_the_feed(spark, drops):
    topic, out = str(drops / "topic"), str(drops / "out")
    results = {"topic": "d", "sink_format": "parquet", "path": topic}
    deliver(drops, 0, 1)
    run(spark, drops, results=results)
    undo_last_commit(drops)
    run(spark, drops, results=results)
    charted = read_reports(spark, out).where("operation = 'avg10second'").count()
    values = spark.readStream.schema("topic STRING, value BINARY").option("maxFilesPerTrigger", 1).parquet(topic)
    for name, options in (("all", {}), ("once", {"once_within": "10 minutes"})):
        feed = feed_stream(values, "charts", str(drops / f"check-{name}"), "json", str(drops / name), DRAIN, **options)
        feed.awaitTermination()
    fed = {name: spark.read.json(str(drops / name)).count() for name in ("all", "once")}
    assert fed["once"] == charted < fed["all"]


def test_relay_check_hears_of_the_end(spark, tmp_path, monkeypatch):
    """The stream's progress ends the wait, without another look at the tables."""
    rows = [(t, 0, o, None, None, bytearray(b"m" if o < 9 else b"END")) for t in ("src", "dst") for o in range(10)]
    tests = register_tests(spark, [("run", "src", "dst")])
    spark.createDataFrame(rows, TOPIC).coalesce(1).write.parquet(str(tmp_path / "in"))
    looked = []
    look = relay.read_progress
    monkeypatch.setattr(relay, "read_progress", lambda *a: looked.append(1) or look(*a))
    stream = stream_topic(spark, "parquet", str(tmp_path / "in"))
    partitions = {"src": 1, "dst": 1}
    started = time.monotonic()
    report = check_relay(stream, tests, "run", "END", str(tmp_path / "out"), str(tmp_path / "check"), partitions, {"processingTime": "1 second"}, check_seconds=600)
    assert report.first().ended and report.first().order_preserved
    assert len(looked) == 1 and time.monotonic() - started < 120
    # Markers of an earlier run count as well.
    again = check_relay(stream, tests, "run", "END", str(tmp_path / "out"), str(tmp_path / "check"), partitions, DRAIN)
    assert again.first().ended


def test_relay_check_hears_of_markers_per_partition(spark):
    class Progress:
        runId = "r"
        observedMetrics = {"progress": {"ended": [{"topic": "src", "partition": 0}]}}

    class Over:
        runId = "r"

    listener = MarkerListener()
    listener.onQueryProgress(type("E", (), {"progress": Progress}))
    assert listener.wait(Over, {("src", 0)}, 1) and not listener.wait(Over, {("src", 0), ("dst", 0)}, 0.1)
    listener.onQueryTerminated(Over)
    assert not listener.wait(Over, {("dst", 0)}, 60)


def paced(spark, rows, folder, **options):
    def release(some, number):
        some.withColumn("slot", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/slot-{number}")

    settings = {"interval_ms": 300, **options}
    return replay_stream(rows, F.col("id"), 100, release, f"{folder}/check", **settings)


def test_replay_keeps_gaps_and_goes_on_after_a_restart(spark, tmp_path):
    folder = str(tmp_path)
    # 30 units an interval; nothing lies from 60 to 149.
    rows = spark.createDataFrame([(i, f"r{i}") for i in [*range(10, 70), *range(160, 200)]], "id LONG, text STRING")
    first = paced(spark, rows, folder)
    while not (tmp_path / "out" / "slot-1" / "_SUCCESS").exists():
        time.sleep(0.1)
    first.query.stop()
    time.sleep(2)  # longer than an interval: a replay does not hurry after the clock
    assert paced(spark, rows, folder).wait(120)
    slots = {r.id: r.slot for r in spark.read.parquet(f"{folder}/out/*").collect()}
    assert slots == {r.id: (r.id - 10) // 30 for r in rows.collect()}


def test_replay_by_time_and_of_nothing(spark, tmp_path):
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = spark.createDataFrame([(i, at + timedelta(milliseconds=350 * i)) for i in range(4)], "id LONG, at TIMESTAMP")
    out = str(tmp_path / "topic")
    values = rows.selectExpr("at", "'t' AS topic", "cast(cast(id AS STRING) AS BINARY) AS value")
    assert replay_to_topic(values, by_time("at"), 1_000_000, str(tmp_path / "a"), 500, sink_format="parquet", path=out).wait(120)
    assert sorted(int(bytes(r.value)) for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3]
    assert replay_stream(rows.limit(0), by_time("at"), 1, lambda *_: None, str(tmp_path / "b"), 200).wait(60)
    with pytest.raises(ValueError):
        replay_stream(rows, by_time("at"), 0, lambda *_: None, str(tmp_path / "c"))


def test_relay_check_stops_at_the_markers(spark, tmp_path):
    """A stream without an end stops by itself once each partition of both topics has shown a marker."""
    rows = [(t, p, o, None, None, bytearray(f"{p}|{o}".encode())) for t, n in (("src", 2), ("dst", 1)) for p in range(n) for o in range(30)]
    tests = register_tests(spark, [("run", "src", "dst")])
    spark.createDataFrame(rows, TOPIC).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stream_topic(spark, "parquet", str(tmp_path / "in"))
    query = archive_stream(stream, "run", "END", str(tmp_path / "out"), str(tmp_path / "check"), {"processingTime": "1 second"})
    query.processAllAvailable()
    partitions = {"src": 2, "dst": 1}
    assert not all_ended(read_progress(spark, str(tmp_path / "out"), tests, partitions))
    query.stop()
    ends = [(r.topic, r.partition, 99, None, None, r.value) for r in marker_values(tests, partitions, "END").collect()]
    spark.createDataFrame(ends, TOPIC).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    report = check_relay(stream, tests, "run", "END", str(tmp_path / "out"), str(tmp_path / "check"), partitions, {"processingTime": "1 second"}, slice_size=10)
    row = report.first()
    assert (row.ended, row.source_total, row.destination_total, row.same_amount) == (True, 60, 30, False)


def test_archive_stream_counts_once(spark, tmp_path):
    rows = [("src", i % 2, i // 2, None, None, bytearray(f"m{i}".encode())) for i in range(40)]
    rows += [("src", p, 20, None, None, bytearray(b"END")) for p in range(2)]
    for i in range(3):
        part = spark.createDataFrame(rows[i * 14 : (i + 1) * 14], TOPIC)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    root, check = str(tmp_path / "out"), str(tmp_path / "check")

    def go():
        stream = stream_topic(spark, "parquet", str(tmp_path / "in"), maxFilesPerTrigger="1")
        query = archive_stream(stream, "run", "END", root, check, DRAIN)
        query.awaitTermination()
        return query

    query = go()
    assert sum(p["observedMetrics"]["progress"].markers for p in query.recentProgress if p["numInputRows"]) == 2
    assert read_messages(spark, root).count() == 40
    assert [tuple(r) for r in read_counters(spark, root).collect()] == [("run", "src", 42)]
    last = max((tmp_path / "check" / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    go()
    assert read_messages(spark, root).count() == 40
    assert [tuple(r) for r in read_counters(spark, root).collect()] == [("run", "src", 42)]
    assert topic_counts(read_messages(spark, root)).first().total == 40
