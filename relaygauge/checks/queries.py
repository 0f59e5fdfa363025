"""Every operator as a query over the given tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, MapType, StringType, StructField, StructType

from relaygauge.checks import fixtures as fx
from relaygauge.functions.clock import epoch_micros
from relaygauge.functions.keys import row_key, separated_row_key
from relaygauge.functions.numbers import int_div
from relaygauge.functions.text import utf8_bytes, utf8_text
from relaygauge.operators import archive, digests, latencies, lines, positions, rolling, series, synthetic, trees, verdicts
from relaygauge.plans import comparison
from relaygauge.plans.dashboard import history_json as dashboard_history
from relaygauge.plans.dataset import dataset_topic as numbered_dataset
from relaygauge.plans.latency import decode_latency_topic, latency_report
from relaygauge.plans.relay import check_relay
from relaygauge.plans.validation import validate, validate_by_fingerprint, validate_ordered
from relaygauge.schemas import EVENT_KEY, LATENCY_EVENT, LATENCY_SPAN, SERIES_KEY, TIMINGS
from relaygauge.session import shared_folder
from relaygauge.sinks import tables
from relaygauge.sinks import topics as topic_sinks
from relaygauge.sinks.ordered import write_ordered
from relaygauge.sinks.text import report_lines, write_lines
from relaygauge.sinks.topics import event_values, framed_values, line_values
from relaygauge.sources import catalogue, records, resolution, results, topics
from relaygauge.streaming import DRAIN
from relaygauge.streaming.archive import archive_stream, read_counters, read_messages
from relaygauge.streaming.replay import replay_stream
from relaygauge.streaming.latency import close_windows, events_table, latency_stream, read_buckets, read_events, read_report_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

HISTORY_NOW = 1_705_320_000  # 2024-01-15 12:00:00
SECOND_BY_SECOND = (("second", 10), ("second", 30), ("minute", 1))
LINE_SHAPE = synthetic.Shape("relay", 10, 200)
DATASET_SHAPE = synthetic.Shape("relay", 1024, 5000)
DATASET_BYTES = 10_000_000
# Of all events, so a file of one of four batches has a quarter of them.
BATCH_FILE_ROWS = 1_000_000
# Events behind a task of sliding windows, each of which makes some 30 of them.
NATIVE_TASK_ROWS = 10_000
# Events behind a task of reports, of each of which two windows of three marks make some 120 values.
REPORT_TASK_ROWS = 10_000


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# Topics and archive


@query
def topic_scan(spark, folder):
    events = fx.events(spark, folder)
    """Both topics as files; errors are bytes that are no UTF-8."""
    root = shared_folder(spark, "topics")
    broken = F.when(F.col("event_type") == "error", F.concat(F.unhex(F.lit("FF")), utf8_bytes("props")))
    rows = fx.topic_rows(events.withColumn("_broken", broken), "src", broken=F.col("_broken"))
    topic_sinks.write_topic(rows, "parquet", f"{root}/src")
    copy = rows.where(F.col("offset") != fx.CHANGED_EVENT).withColumn("topic", F.lit("dst"))
    topic_sinks.write_topic(copy, "parquet", f"{root}/dst")
    read = [topics.read_topic(spark, "parquet", f"{root}/{t}") for t in ("src", "dst")]
    return archive.project_messages(topics.topics_union(*read), "dropped")


@query
def topic_counts(spark, folder):
    return archive.topic_counts(fx.marked_archive(spark, folder))


@query
def archive_counts(spark, folder):
    return archive.archive_counts(fx.marked_archive(spark, folder), fx.MARKER)


@query
def end_markers(spark, folder):
    """Markers for the partitions that the topics in the table have."""
    used = fx.archive(spark, folder).groupBy("test_id", "topic", "partition").count()
    markers = archive.end_markers(fx.tests(spark), fx.PARTITIONS, fx.MARKER)
    return markers.join(used, ["test_id", "topic", "partition"]).select(
        "test_id", "topic", "partition", "payload", F.col("count").alias("messages_before")
    )


@query
def marker_filter(spark, folder):
    return archive.drop_markers(fx.marked_archive(spark, folder), fx.MARKER)


@query
def stream_progress(spark, folder):
    return archive.stream_progress(fx.marked_archive(spark, folder), fx.tests(spark), fx.PARTITIONS, fx.MARKER)


@query
def message_archive(spark, folder):
    return archive.archive_messages(fx.delivered_twice(spark, folder), "delivery")


@query
def message_archive_rowkey(spark, folder):
    """Colliding keys: the later offset wins, as it is written later."""
    written = fx.archive(spark, folder, partitions=16).withColumn("written", F.col("offset"))
    return archive.archive_messages_by_row_key(written, "written")


@query
def row_keys(spark, folder):
    keyed = fx.archive(spark, folder)
    return keyed.select(
        "test_id",
        "topic",
        "offset",
        row_key().alias("joined_key"),
        F.replace(separated_row_key(), F.lit("\u0001"), F.lit("/")).alias("separated_key"),
    )


@query
def test_lookup(spark, folder):
    """A registry with one test per event type; two ids are asked for, one is unknown."""
    kinds = fx.events(spark, folder).select("event_type").distinct()
    registry = kinds.select(
        F.col("event_type").alias("test_id"),
        F.col("event_type").alias("source_topic"),
        F.concat(F.lit("mirror_"), "event_type").alias("destination_topic"),
    )
    wanted = spark.createDataFrame([("purchase",), ("absent",)], "test_id STRING")
    return archive.lookup_tests(registry, wanted)


# Positions, digests, verdicts


@query
def message_positions(spark, folder):
    return positions.message_positions(fx.archive(spark, folder))


def _line_topic(spark, folder):
    return lines.lines_to_messages(fx.table(spark, folder, "documents"), "doc_id", "text", "lines", fx.PARTITIONS)


@query
def message_positions_dense(spark, folder):
    messages = archive.project_messages(_line_topic(spark, folder), "lines")
    return positions.dense_positions(messages)


@query
def slice_digests(spark, folder):
    return digests.slice_digests(fx.archive(spark, folder))


@query
def slice_digests_strict(spark, folder):
    return digests.slice_digests(fx.archive(spark, folder), strict=True)


@query
def slice_digests_dense(spark, folder):
    return digests.slice_digests_dense(archive.project_messages(_line_topic(spark, folder), "lines"))


@query
def slice_digests_rowkey(spark, folder):
    """Twelve and more partitions: joined keys collide and follow by partition."""
    return digests.slice_digests_by_row_key(fx.archive(spark, folder, partitions=16))


def _compared(spark, folder):
    return digests.compare_slices(digests.slice_digests(fx.archive(spark, folder)), fx.tests(spark))


@query
def slice_compare(spark, folder):
    return _compared(spark, folder)


@query
def order_verdict(spark, folder):
    return verdicts.order_verdict(_compared(spark, folder), fx.tests(spark))


@query
def count_verdict(spark, folder):
    counts = archive.archive_counts(fx.marked_archive(spark, folder), fx.MARKER)
    return verdicts.count_verdict(counts, fx.tests(spark))


def _wanted(spark):
    return spark.createDataFrame([(t[0],) for t in fx.TESTS] + [("absent",)], "test_id STRING")


@query
def validation_report(spark, folder):
    return validate(fx.marked_archive(spark, folder), fx.tests(spark), fx.MARKER, wanted=_wanted(spark))


@query
def validation_report_strict(spark, folder):
    return validate(fx.marked_archive(spark, folder), fx.tests(spark), fx.MARKER, strict=True)


@query
def validation_report_fingerprint(spark, folder):
    messages = fx.marked_archive(spark, folder)
    return validate_by_fingerprint(messages, fx.tests(spark), fx.MARKER, wanted=_wanted(spark))


@query
def validation_report_gapless(spark, folder):
    """The fingerprint path where offsets have no gaps, in the lines of the documents."""
    source = archive.project_messages(_line_topic(spark, folder), "lines")
    copy = source.withColumn("topic", F.lit("copied"))
    edited = (F.col("partition") == 1) & (F.col("offset") == 2)
    broken = copy.withColumns(
        {"test_id": F.lit("edited"), "payload": F.when(edited, F.lit("!")).otherwise(F.col("payload"))}
    )
    messages = source.unionByName(copy).unionByName(source.withColumn("test_id", F.lit("edited"))).unionByName(broken)
    tests = archive.register_tests(spark, [("lines", "lines", "copied"), ("edited", "lines", "copied")])
    return validate_by_fingerprint(messages, tests)


def _ordered(spark, folder):
    return write_ordered(fx.marked_archive(spark, folder), shared_folder(spark, "ordered"))


@query
def validation_report_ordered(spark, folder):
    """The report on an archive that is stored in the order of its messages."""
    return validate_ordered(_ordered(spark, folder), fx.tests(spark), fx.MARKER, wanted=_wanted(spark))


@query
def slice_digests_ordered(spark, folder):
    located = archive.drop_markers(_ordered(spark, folder), fx.MARKER)
    return digests.slice_digests_ordered(located)


@query
def digest_tree(spark, folder):
    """The nodes that each topic's tree has, and how many messages are below them."""
    return trees.tree_nodes(fx.archive(spark, folder)).drop("print0", "print1")


@query
def first_difference(spark, folder):
    """Found by descent of trees that were made batch by batch."""
    root = shared_folder(spark, "trees")
    messages = fx.archive(spark, folder)
    for batch in range(3):
        some = messages.where(F.pmod("offset", F.lit(3)) == batch)
        trees.tree_nodes(some).write.mode("append").parquet(f"{root}/batches")
    trees.added_nodes(spark.read.parquet(f"{root}/batches")).write.parquet(f"{root}/nodes")
    return comparison.first_differences(spark.read.parquet(f"{root}/nodes"), messages, fx.tests(spark))


@query
def content_alignment(spark, folder):
    return comparison.compare_by_content(fx.archive(spark, folder), fx.tests(spark), 100)


@query
def verdict_lines(spark, folder):
    return report_lines(validation_report(spark, folder))


# Latencies


def _flat_record():
    marks = {"created": 1, "consumed": 2, "produced": 3}
    return [
        "event_id",
        F.col("tag")["topic"].alias("topic"),
        F.col("tag")["partition"].alias("partition"),
        F.col("tag")["consumerId"].alias("consumerid"),
        *[F.try_element_at("timings", F.lit(i))["value"].alias(name) for name, i in marks.items()],
        F.unix_micros("arrived_at").alias("arrived_us"),
    ]


@query
def latency_scan(spark, folder):
    start = HISTORY_NOW * 1_000_000  # in the midst of the events
    return topics.from_latest(fx.records(spark, folder), start, "arrived_at").select(*_flat_record())


@query
def tag_extract(spark, folder):
    return latencies.extract_tags(fx.records_with_gaps(spark, folder)).select(
        "event_id", "topic", "partition", "consumerid", "missing_tag"
    )


def _flat_pairs(records_):
    return latencies.latency_pairs(records_).select(
        "topic", "partition", "consumerid", "eventname", "latency", F.unix_micros("arrived_at").alias("arrived_us")
    )


@query
def timing_pairs(spark, folder):
    return _flat_pairs(fx.records(spark, folder))


@query
def timing_pairs_repeated(spark, folder):
    return _flat_pairs(fx.records_with_repeats(spark, folder))


@query
def latency_buckets(spark, folder):
    return fx.buckets(spark, folder)


def _rolling(unit, length):
    def run(spark, folder):
        return rolling.rolling_averages(fx.buckets(spark, folder), [(unit, length)])

    run.__name__ = f"rolling_{length}{unit}"
    return run


def _rolling_spans(unit, length):
    """Long windows without loss: windows at consecutive seconds over the same buckets are one row."""

    def run(spark, folder):
        return rolling.rolling_spans(fx.buckets(spark, folder), [(unit, length)])

    run.__name__ = f"rolling_{length}{unit}"
    return run


for _unit, _length in rolling.WINDOWS:
    query((_rolling if (_unit, _length) in SECOND_BY_SECOND else _rolling_spans)(_unit, _length))


@query
def rolling_all_windows(spark, folder):
    """All six windows in one pass over the buckets, every second of them."""
    return rolling.rolling_spans(fx.buckets(spark, folder))


@query
def rolling_10second_native(spark, folder):
    tasks = 1 + fx.events(spark, folder).count() // NATIVE_TASK_ROWS
    return rolling.native_rolling_averages(fx.buckets(spark, folder), "second", 10, tasks)


@query
def latency_from_frames(spark, folder):
    """Framed JSON records to averages of ten seconds; frames of error events have another format."""
    framed = fx.framed_records(spark, folder)
    schema = records.RecordSchema(7, "latency", fields=fx.RECORD_FIELDS, required="timings")
    decoded = decode_latency_topic(framed, [schema])
    return latency_report(decoded.where("problem IS NULL"), [("second", 10)])


# Results


@query
def events_upsert(spark, folder):
    """Events evaluated again for one topic replace the first ones; stored as spans of seconds."""
    first = fx.result_spans(spark, folder)
    again = first.where("topic = 'purchase'").withColumn("value", F.col("value") + 1)
    path = shared_folder(spark, "events")
    tables.write_batch(first, path, 0, ["topic"])
    tables.write_batch(again, path, 1, ["topic"])
    return rolling.unfold_spans(tables.read_spans(spark, path))


@query
def events_levels(spark, folder):
    """Events that come in many batches and again for one topic, stored as spans and merged by levels on the way."""
    first = fx.result_spans(spark, folder)
    again = first.where("topic = 'purchase'").withColumn("value", F.col("value") + 1)
    table = replace(events_table(spark, shared_folder(spark, "levels")), width=3)
    pieces = first.persist()
    key = [c for c in LATENCY_SPAN.names if c not in ("until", "value", "cnt")]
    # Batches are written where their spans lie, by as many tasks.
    for batch in range(6):
        table.append(pieces.where(F.pmod(F.xxhash64(*key), F.lit(6)) == batch), batch, files=None)
    table.append(again, 6, files=None)
    pieces.unpersist()
    return rolling.unfold_spans(table.current())


@query
def events_history(spark, folder):
    return series.events_history(fx.results(spark, folder), "click", HISTORY_NOW)


@query
def history_json(spark, folder):
    return dashboard_history(fx.results(spark, folder), "click", HISTORY_NOW)


@query
def live_feed(spark, folder):
    """Result values of which those of one partition are cut off and so skipped."""
    value = results.topic_event_json()
    cut = F.when(F.col("partition") == "3", F.substring(value, 1, 25)).otherwise(value)
    return results.live_feed(fx.results(spark, folder).select(cut.alias("value")))


@query
def event_json(spark, folder):
    return fx.results(spark, folder).select(*EVENT_KEY, results.event_json().alias("json"))


@query
def result_topic_values(spark, folder):
    values = event_values(fx.results(spark, folder), "dataset")
    return values.select("topic", utf8_text(F.col("value")).alias("json"))


@query
def series_long(spark, folder):
    points = series.series_long(series.chart_events(fx.results(spark, folder)))
    return points.withColumn("time", F.unix_micros("time"))


def _points(spark, folder, merge):
    charted = series.series_points(series.chart_events(fx.results(spark, folder)), merge)
    text = F.transform("points", lambda p: F.concat_ws(":", p["second"].cast("string"), p["eventname"], p["y"].cast("string")))
    return charted.withColumn("points", F.array_join(text, ";"))


@query
def series_points(spark, folder):
    return _points(spark, folder, False)


@query
def series_points_merged(spark, folder):
    return _points(spark, folder, True)


@query
def series_extent(spark, folder):
    return series.series_extent(series.chart_events(fx.results(spark, folder)))


# Records


@query
def wire_frame_split(spark, folder):
    split = records.split_frames(fx.frames(spark, folder))
    return split.select("event_id", "schema_id", F.hex("body").alias("body"), "problem")


@query
def wire_frame_build(spark, folder):
    framed = framed_values(fx.events(spark, folder), "metrics", 42, utf8_bytes(F.col("props")))
    return framed.select("topic", F.hex("value").alias("value"))


_COUNTER = StructType([StructField("k", LongType())])
_MARKS = StructType([StructField("id", LongType()), StructField("timings", TIMINGS)])
_METRIC = StructType([StructField("id", LongType()), StructField("timings", MapType(StringType(), LongType()))])
_TARGET = StructType([StructField("id", LongType()), StructField("timings", TIMINGS), StructField("k", LongType())])


@query
def record_decode(spark, folder):
    """Schemas come from their texts, as a catalogue holds them."""
    texts = [
        ("a", '{"type":"record","name":"counter","fields":[{"name":"k","type":["null","long"]}]}'),
        ("b", '{"type":"string","name":"label"}'),
        ("c", '{"type":"bytes","name":"blob"}'),
    ]
    known = catalogue.catalogue(spark.createDataFrame(texts, "origin STRING, value STRING"))
    schemas = catalogue.record_schemas(known, {"counter": 1, "label": 2, "blob": 3})
    framed = records.split_frames(fx.frames(spark, folder))
    return records.decode_records(framed, schemas, _COUNTER).select(
        "event_id", "name", F.col("record")["k"].alias("k"), "text", F.hex("bytes").alias("bytes"), "problem"
    )


@query
def record_versions(spark, folder):
    """Three versions of one schema, by their fingerprints, read as a newer one; the third does not fit it."""
    versions = [
        '{"type":"record","name":"counter","fields":[{"name":"k","type":"int"}]}',
        '{"type":"record","name":"counter","fields":[{"name":"k","type":["null","long"]}]}',
        '{"type":"record","name":"counter","fields":[{"name":"k","type":"string"}]}',
    ]
    reader = """{"type":"record","name":"counter","fields":[
        {"name":"n","type":"long","aliases":["k"]},
        {"name":"unit","type":"string","default":"things"},
        {"name":"more","type":["null","long"],"default":null}]}"""
    known = catalogue.catalogue(spark.createDataFrame([(v, v) for v in versions], "origin STRING, value STRING"))
    schemas = catalogue.record_schemas(known, {resolution.fingerprint(v): i + 1 for i, v in enumerate(versions)})
    framed = records.split_frames(fx.frames(spark, folder))
    return records.decode_records(framed, schemas, reader=reader).select("event_id", "record.*", "problem")


@query
def fallback_decode(spark, folder):
    kind, at = F.col("event_type"), epoch_micros(F.col("ts"))
    value = (
        F.when(kind == "purchase", F.format_string('{"id": %d, "timings": {"created": %d}}', "event_id", at))
        .when(
            kind == "signup",
            F.format_string('{"id": %d, "timings": [{"key": "created", "value": %d}]}', "event_id", at),
        )
        .when(kind == "error", F.concat(F.lit("junk "), "props"))
        .otherwise(F.col("props"))
    )
    schemas = [
        records.RecordSchema(1, "marks", fields=_MARKS, required="timings"),
        records.RecordSchema(2, "metric", fields=_METRIC, required="timings"),
        records.RecordSchema(3, "counter", fields=_COUNTER, required="k"),
    ]
    decoded = records.decode_with_fallback(
        fx.events(spark, folder).select("event_id", value.alias("value")), schemas, _TARGET
    )
    first = F.get("record.timings", F.lit(0))
    return decoded.select(
        "event_id", "schema", "record.id", "record.k", first["key"].alias("mark"), first["value"].alias("marked_at")
    )


@query
def schema_catalog(spark, folder):
    """A schema text per event type, one of them no schema at all."""
    kinds = fx.events(spark, folder).select("event_type").distinct()
    fields = '"fields":[{"name":"id","type":"long"},{"name":"k","type":"long"}]'
    text = F.format_string('{"type":"record","name":"%s","namespace":"metrics",' + fields + "}", "event_type")
    texts = kinds.select(
        F.col("event_type").alias("origin"),
        F.when(F.col("event_type") == "error", F.lit("no schema")).otherwise(text).alias("value"),
    )
    return catalogue.catalogue(texts).select(
        "origin", "name", "namespace", "kind", F.array_join("fields", ",").alias("fields")
    )


# Datasets


@query
def lines_to_messages(spark, folder):
    return _line_topic(spark, folder).select("topic", "partition", "offset", utf8_text(F.col("value")).alias("payload"))


@query
def line_topic_values(spark, folder):
    values = line_values(fx.document_lines(spark, folder), "dataset")
    return values.select("topic", F.md5("value").alias("value_md5"), F.octet_length("value").alias("n_bytes"))


@query
def line_export(spark, folder):
    """The export as its files hold it; lines come back in no order."""
    root = shared_folder(spark, "export")
    write_lines(fx.document_lines(spark, folder).select("line"), root)
    return spark.read.text(root).select(F.concat("value", F.lit("\n")).alias("line"))


@query
def replay(spark, folder):
    return synthetic.replay(fx.events(spark, folder).select("event_id", "props"), 3)


def _ids(spark, folder):
    return fx.events(spark, folder).select(F.col("event_id").alias("id"))


@query
def synthetic_lines(spark, folder):
    return synthetic.generate("lines", _ids(spark, folder), LINE_SHAPE)


@query
def size_bounded_lines(spark, folder):
    kept = synthetic.size_bounded_ids(_ids(spark, folder), DATASET_BYTES, DATASET_SHAPE)
    made = synthetic.synthetic_lines(kept, DATASET_SHAPE)
    return made.select("id", F.octet_length("line").alias("n_bytes"), F.md5("line").alias("line_md5"))


@query
def dataset_topic(spark, folder):
    numbered = numbered_dataset(_ids(spark, folder), DATASET_BYTES, DATASET_SHAPE, "dataset", fx.PARTITIONS)
    return numbered.select("topic", "partition", "offset", F.md5("value").alias("value_md5"))


@query
def metric_records(spark, folder):
    at = int_div(epoch_micros(F.col("ts")), 1000)
    ids = fx.events(spark, folder).select(F.col("event_id").alias("id"), at.alias("created_ms"))
    made = synthetic.generate("metrics", ids, LINE_SHAPE)
    return made.select("id", F.col("timings")["created"].alias("created"), utf8_text(F.col("value")).alias("value"))


@query
def paced_replay(spark, folder):
    """Events released again by their time, a quarter of it an interval, with the interval each came in."""
    root = shared_folder(spark, "replay")
    rows = fx.events(spark, folder)
    at = epoch_micros(F.col("ts"))
    low, high = rows.agg(F.min(at), F.max(at)).first()

    def release(some, number):
        some.select("event_id", "props", F.lit(number).alias("slot")).write.mode("overwrite").parquet(f"{root}/out/slot-{number}")

    replay_stream(rows, at, (high - low) // 4 + 1, release, f"{root}/checkpoint").wait()
    return spark.read.parquet(f"{root}/out/*")


@query
def report_feed(spark, folder):
    """Reports of a batch that was sent twice, and of windows that a later batch reports again: once each."""
    # Spans are few and unfold into many events: a small table of them is a task for each core, no fewer.
    at_least = spark.sparkContext.defaultParallelism
    n = fx.events(spark, folder).count()
    spans = fx.result_spans(spark, folder).repartition(max(at_least, n // REPORT_TASK_ROWS), *SERIES_KEY, "from")
    events = rolling.unfold_spans(spans)
    later = events.where("topic = 'purchase'")
    values = event_values(events, "dataset", 0)
    sent = values.unionByName(values).unionByName(event_values(later, "dataset", 2))
    tasks = max(at_least, 2 * n // REPORT_TASK_ROWS)
    reports = results.reported_once(results.decode_reports(sent), "10 minutes", tasks)
    return reports.select(*LATENCY_EVENT.names, "batch")


# Streams, each drained into tables below the shared folder


def _event_stream(spark, folder):
    schema = fx.events(spark, folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)


@query
def stream_message_archive(spark, folder):
    """Archived and counted messages of a topic in which error events stand for end markers."""
    root = shared_folder(spark, "archive")
    marked = F.when(F.col("event_type") == "error", utf8_bytes(F.lit(fx.MARKER)))
    rows = _event_stream(spark, folder)
    envelopes = rows.select(
        F.lit("src").alias("topic"),
        fx.partition_of().alias("partition"),
        F.col("event_id").alias("offset"),
        F.coalesce(marked, utf8_bytes(fx.payload())).alias("value"),
    )
    archive_stream(envelopes, "faithful", fx.MARKER, root, f"{root}/checkpoint", DRAIN).awaitTermination()
    return read_messages(spark, root).join(read_counters(spark, root), ["test_id", "topic"])


@query
def stream_relay_check(spark, folder):
    """Both topics streamed and archived until every partition has ended, then validated."""
    root = shared_folder(spark, "relay")
    events = fx.events(spark, folder)
    copy = events.where(F.col("event_id") != fx.CHANGED_EVENT)
    tests = archive.register_tests(spark, [("dropped", "src", "dst")])
    partitions = {"src": fx.PARTITIONS, "dst": fx.PARTITIONS}
    ends = archive.marker_values(tests, partitions, fx.MARKER).select(
        "topic",
        "partition",
        F.lit(fx.AFTER_ALL_OFFSETS).alias("offset"),
        F.lit(None).cast("timestamp").alias("timestamp"),
        F.lit(None).cast("binary").alias("key"),
        "value",
    )
    for rows in (fx.topic_rows(events, "src"), fx.topic_rows(copy, "dst"), ends):
        topic_sinks.write_topic(rows, "parquet", f"{root}/topics")
    stream = topics.stream_topic(spark, "parquet", f"{root}/topics")
    return check_relay(stream, tests, "dropped", fx.MARKER, f"{root}/archive", f"{root}/checkpoint", partitions, DRAIN)


def _latency_job(spark, folder):
    root = shared_folder(spark, "latency")
    stream = fx.records_of(_event_stream(spark, folder)).select("tag", "timings", "arrived_at")
    latency_stream(stream, root, f"{root}/checkpoint", [("second", 10)], trigger=DRAIN).awaitTermination()
    close_windows(spark, root, [("second", 10)])
    return root


@query
def stream_latency_buckets(spark, folder):
    return read_buckets(spark, _latency_job(spark, folder))


@query
def stream_rolling_10second(spark, folder):
    return read_events(spark, _latency_job(spark, folder))


@query
def stream_window_reports(spark, folder):
    """How often each window is reported by a stream of several batches in the order of time: once."""
    root = shared_folder(spark, "reports")
    ordered = fx.events(spark, folder).withColumn("_at", epoch_micros(F.col("ts")))
    cuts = ordered.approxQuantile("_at", [0.25, 0.5, 0.75], 0.001)
    # Each batch has as many files; a file is read by one task.
    files = 1 + ordered.count() // BATCH_FILE_ROWS
    earlier = F.lit(False)
    for cut in [*cuts, None]:
        upto = F.lit(True) if cut is None else F.col("_at") <= int(cut)
        ordered.where(upto & ~earlier).repartition(files).write.mode("append").parquet(f"{root}/in")
        earlier = upto
    stream = spark.readStream.schema(ordered.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/in")
    records_ = fx.records_of(stream).select("tag", "timings", "arrived_at")
    windows = fx.RESULT_WINDOWS
    latency_stream(records_, root, f"{root}/checkpoint", windows, trigger=DRAIN).awaitTermination()
    close_windows(spark, root, windows)
    return read_report_counts(spark, root)
