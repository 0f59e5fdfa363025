"""Frames, record decoding, schema catalogues, lines, tables and reports."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, MapType, StringType, StructField, StructType

from relaygauge.checks.queries import QUERIES
from relaygauge.functions.frames import build_frame
from relaygauge.functions.text import count_lines, split_lines, utf8_bytes
from relaygauge.operators import synthetic
from relaygauge.operators.lines import lines_to_messages, newline_terminated
from relaygauge.operators.rolling import unfold_spans
from relaygauge.schemas import EVENT_KEY, LATENCY_EVENT, LATENCY_SPAN, TIMINGS, TOPIC
from relaygauge.sinks import tables, text, topics as topic_sinks
from relaygauge.sinks.levels import LevelledTable
from relaygauge.sources import catalogue, lines as line_source, records, results, topics

COUNTER = StructType([StructField("k", LongType())])


def test_frames_split(spark):
    values = [bytes.fromhex(h) for h in ("000000002A0102", "010000002A0102", "0001", "", "00FFFFFFFF")] + [None]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, value BINARY")
    got = {r.i: (r.schema_id, r.body and bytes(r.body), r.problem) for r in records.split_frames(frame).collect()}
    assert got[0] == (42, b"\x01\x02", None)
    assert got[1] == (None, None, "unknown magic byte")
    assert got[2] == got[3] == got[5] == (None, None, "truncated")
    assert got[4][0] == 2**32 - 1 and got[4][2] is None


def test_frames_round_trip(spark):
    ids = [0, 1, 42, 2**31, 2**32 - 1]
    frame = spark.createDataFrame([(i,) for i in ids], "id BIGINT")
    framed = frame.select("id", build_frame(F.col("id"), utf8_bytes(F.lit("é"))).alias("value"))
    assert all(r.schema_id == r.id and bytes(r.body) == "é".encode() for r in records.split_frames(framed).collect())


def decoded(spark, framed, target=COUNTER):
    schemas = [
        records.RecordSchema(1, "counter", fields=COUNTER),
        records.RecordSchema(4, "metric", fields=StructType([StructField("timings", MapType(StringType(), LongType()))])),
        records.RecordSchema(2, "label", kind="string"),
        records.RecordSchema(3, "blob", kind="bytes"),
    ]
    frame = spark.createDataFrame(framed, "schema_id BIGINT, body STRING")
    values = frame.select(build_frame(F.col("schema_id"), utf8_bytes(F.col("body"))).alias("value"))
    return records.decode_records(records.split_frames(values), schemas, target).collect()


def test_records_decode_by_kind(spark):
    got = {(r.name, r.problem): r for r in decoded(spark, [(1, '{"k": 5}'), (1, "junk"), (2, "é"), (3, "x"), (9, "x")])}
    assert got[("counter", None)].record.k == 5
    assert ("counter", "undecodable") in got and (None, "unknown schema") in got
    assert got[("label", None)].text == "é" and bytes(got[("blob", None)].bytes) == b"x"


def test_fields_may_be_null_but_not_damaged(spark):
    got = decoded(spark, [(1, '{"k": null}'), (1, "{}"), (1, '{"k": "x"}'), (1, '{"k": 1'), (1, "[1]")])
    assert [r.problem for r in got] == [None, None, "undecodable", "undecodable", "undecodable"]
    assert got[0].record.k is None


def test_schema_texts_become_schemas(spark):
    text = (
        '{"type":"record","name":"metric","fields":[{"name":"id","type":"int"},{"name":"value","type":"bytes"},'
        '{"name":"timings","type":[{"type":"map","values":"long"},"null"]},{"name":"marks","type":{"type":"array","items":"long"}}]}'
    )
    schema = catalogue.record_schema(7, text)
    assert schema.fields.simpleString() == "struct<id:int,value:binary,timings:map<string,bigint>,marks:array<bigint>>"
    assert catalogue.record_schema(8, '"string"').kind == "string"
    known = catalogue.catalogue(spark.createDataFrame([("a", text), ("b", "junk")], "origin STRING, value STRING"))
    assert catalogue.record_schemas(known, {"metric": 7}) == [schema]
    with pytest.raises(ValueError):
        catalogue.record_schema(1, '{"type":"record","name":"x","fields":[{"name":"y","type":["long","int"]}]}')


def test_map_timings_become_marks(spark):
    target = StructType([StructField("timings", TIMINGS), StructField("k", LongType())])
    row = decoded(spark, [(4, '{"timings": {"b": 9, "a": 2}}')], target)[0]
    assert [(m.key, m.value) for m in row.record.timings] == [("a", 2), ("b", 9)] and row.record.k is None


def test_fallback_is_chosen_per_row(spark):
    schemas = [
        records.RecordSchema(1, "first", fields=StructType([StructField("a", LongType())])),
        records.RecordSchema(2, "second", fields=COUNTER),
    ]
    target = StructType([StructField("a", LongType()), StructField("k", LongType())])
    rows = spark.createDataFrame([('{"k": 1}',), ('{"a": 2}',), ("junk",), ('{"a": 3, "k": 4}',), (None,)], "value STRING")
    got = [(r.schema, r.record and tuple(r.record)) for r in records.decode_with_fallback(rows, schemas, target).collect()]
    assert got == [("second", (None, 1)), ("first", (2, None)), (None, None), ("first", (3, None)), (None, None)]


def test_schema_checks():
    with pytest.raises(ValueError):
        records.RecordSchema(1, "x", kind="map")
    with pytest.raises(ValueError):
        records.RecordSchema(1, "x")
    with pytest.raises(ValueError):
        records.decode_with_fallback(None, [], COUNTER)


def test_catalogue_of_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.avsc").write_text('{"type":"record","name":"A","namespace":"n",\n"fields":[{"name":"id","type":"long"},{"name":"v","type":{"type":"map","values":"long"}}]}')
    (tmp_path / "deep" / "b.avsc").write_text('{"type":"bytes","name":"B"}')
    (tmp_path / "c.txt").write_text("no schema")
    got = {r.name: (r.kind, r.fields, r.origin.rsplit("/", 1)[-1]) for r in catalogue.read_catalogue(spark, str(tmp_path)).collect()}
    assert got == {"A": ("record", ["id", "v"], "a.avsc"), "B": ("bytes", None, "b.avsc"), None: (None, None, "c.txt")}
    assert catalogue.read_catalogue(spark, str(tmp_path / "a.avsc")).count() == 1


TEXTS = ["", "\n", "a", "a\n", "a\n\n", "a\r\nb", "a\rb\n", "\r\n\r\n", "é\nß", "a\r\r\nb"]


def test_lines_of_texts(spark):
    frame = spark.createDataFrame([(t,) for t in TEXTS], "t STRING")
    for row in frame.select("t", split_lines(F.col("t")).alias("lines"), count_lines(F.col("t")).alias("n")).collect():
        expected = row.t.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        expected = expected[:-1] if expected[-1] == "" else expected
        assert (row.lines, row.n) == (expected, len(expected))


def test_lines_read_from_files_match_split(spark, tmp_path):
    for i, t in enumerate(TEXTS):
        (tmp_path / f"{i}.txt").write_bytes(t.encode())
    whole = spark.createDataFrame([(t,) for t in TEXTS], "t STRING").select(F.explode(split_lines(F.col("t"))))
    read = line_source.read_lines(spark, str(tmp_path))
    assert sorted(r[0] for r in read.collect()) == sorted(r[0] for r in whole.collect())


def test_offsets_of_lines(spark):
    texts = spark.createDataFrame([(i * 4, f"x{i}\ny{i}" if i % 2 else f"z{i}") for i in range(40)] + [(8001, "w")], "id BIGINT, t STRING")
    got = lines_to_messages(texts, "id", "t", "topic", 4).orderBy("partition", "offset").collect()
    expected = [v for i in range(40) for v in ([f"x{i}", f"y{i}"] if i % 2 else [f"z{i}"])]
    assert [(r.partition, r.offset, bytes(r.value).decode()) for r in got] == [(0, i, v) for i, v in enumerate(expected)] + [(1, 0, "w")]


def test_exports_are_newline_terminated(spark, tmp_path):
    lines = spark.createDataFrame([("a",), ("",)], "line STRING")
    assert [r.line for r in newline_terminated(lines).collect()] == ["a\n", "\n"]
    text.write_lines(lines.coalesce(1), str(tmp_path / "out"))
    assert next((tmp_path / "out").glob("part-*")).read_text() == "a\n\n"


EVENT = ("t", "0", "c", "a-b", 5, "avg10second", 7, 1)


def test_tables_keep_the_newest_version(spark, tmp_path):
    path = str(tmp_path / "events")
    first = spark.createDataFrame([EVENT, ("u",) + EVENT[1:]], LATENCY_EVENT)
    second = spark.createDataFrame([EVENT[:6] + (8, 2)], LATENCY_EVENT)
    tables.write_batch(first, path, 0, ["topic"])
    tables.write_batch(second, path, 1, ["topic"], files=1)
    tables.write_batch(second, path, 1, ["topic"])  # the batch is run again
    assert tables.read_versions(spark, path, LATENCY_EVENT).count() == 3
    current = tables.read_table(spark, path, LATENCY_EVENT, EVENT_KEY)
    assert {(r.topic, r.value, r.cnt) for r in current.collect()} == {("t", 8, 2), ("u", 7, 1)}
    tables.compact(spark, path, str(tmp_path / "compacted"), LATENCY_EVENT, EVENT_KEY, ["topic"])
    assert tables.read_versions(spark, str(tmp_path / "compacted"), LATENCY_EVENT).count() == 2


def test_table_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "events")
    tables.write_batch(spark.createDataFrame([EVENT], LATENCY_EVENT), path, 0, ["topic"])
    current = tables.read_table(spark, path, LATENCY_EVENT, EVENT_KEY)
    plan = current.where("topic = 't' AND second > 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(topic" in plan and "GreaterThan(second,3)" in plan


def test_topic_files_round_trip(spark, tmp_path):
    path = str(tmp_path / "topic")
    rows = [("t", 0, 1, None, None, bytearray(b"x"))]
    spark.createDataFrame(rows, TOPIC).write.parquet(path)
    assert topics.read_topic(spark, "parquet", path).collect() == spark.createDataFrame(rows, TOPIC).collect()
    both = topics.topics_union(topics.read_topic(spark, "parquet", path), topics.read_topic(spark, "parquet", path))
    assert both.count() == 2


def test_events_through_a_topic(spark, tmp_path):
    events = spark.createDataFrame([EVENT, EVENT[:5] + ("avg1minute", 7, 1)], LATENCY_EVENT)
    path = str(tmp_path / "out")
    topic_sinks.write_topic(topic_sinks.event_values(events, "d"), "parquet", path)
    values = spark.read.parquet(path)
    assert {r.topic for r in values.collect()} == {"d-latencies"}
    junk = spark.createDataFrame([(None, None), (None, bytearray(b"{")), (None, bytearray(b'{"topic": "t"}'))], values.schema)
    assert results.decode_events(values.union(junk)).exceptAll(events).isEmpty()
    assert [tuple(r) for r in results.live_feed(values.union(junk)).collect()] == [EVENT]


def test_the_feed_parses_only_what_may_be_charted(spark):
    events = spark.createDataFrame([EVENT, EVENT[:5] + ("avg30second", 7, 1)], LATENCY_EVENT)
    values = events.select(F.when(F.col("operation") != "avg10second", F.lit("no JSON")).otherwise(results.topic_event_json()).alias("value"))
    # Escapes may spell the operation in other ways.
    escaped = values.select(F.replace("value", F.lit("avg10"), F.lit("\\u0061vg10")).alias("value"))
    fed = results.live_feed(values.unionByName(escaped))
    assert [tuple(r) for r in fed.collect()] == [EVENT, EVENT]
    plan = fed._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" in plan and plan.index("Generate") < plan.index("Contains(")


def test_generators_can_be_added(spark):
    synthetic.register_generator("ids", lambda ids, shape: ids.select((F.col("id") + shape.longest).alias("x")))
    assert [r.x for r in synthetic.generate("ids", spark.range(2), synthetic.Shape("s", 0, 10)).collect()] == [10, 11]
    with pytest.raises(ValueError):
        synthetic.generate("none", spark.range(1), synthetic.Shape("s", 0, 1))


def test_metric_records(spark):
    ids = spark.createDataFrame([(3, 1700000000123)], "id BIGINT, created_ms BIGINT")
    row = synthetic.metric_records(ids, synthetic.Shape("s", 10, 100)).first()
    assert row.id == 0 and row.timings == {"created": 1700000000123000000} and len(row.value) == 91


def test_tables_of_spans_keep_the_newest_second(spark, tmp_path):
    path, span = str(tmp_path / "spans"), ("t", "0", "c", "a-b", "avg10second")
    tables.write_batch(spark.createDataFrame([span + (5, 15, 7, 1), ("u",) + span[1:] + (5, 15, 7, 1)], LATENCY_SPAN), path, 0, ["topic"])
    tables.write_batch(spark.createDataFrame([span + (9, 11, 8, 2)], LATENCY_SPAN), path, 1, ["topic"])
    events = unfold_spans(tables.read_spans(spark, path)).collect()
    assert len(events) == 20
    assert {(r.second, r.value) for r in events if r.topic == "t"} == {(s, 8 if s in (9, 10) else 7) for s in range(5, 15)}


def test_queries_on_events_store_a_row_per_span(spark, monkeypatch):
    """A row per second grew with the windows, and levels wrote each batch in one task."""
    stored = {"events_upsert": [], "events_levels": []}
    write, add = tables.write_batch, LevelledTable.append

    def written(rows, *others, **options):
        stored["events_upsert"].append(rows.count())
        return write(rows, *others, **options)

    def added(self, rows, batch, files=1, **options):
        assert files is None
        stored["events_levels"].append(rows.count())
        return add(self, rows, batch, files, **options)

    monkeypatch.setattr(tables, "write_batch", written)
    monkeypatch.setattr(LevelledTable, "append", added)
    for name, counts in stored.items():
        events = QUERIES[name](spark, "/root/testdata/sf0.001").count()
        assert 0 < 4 * sum(counts) < events
