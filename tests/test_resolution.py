"""Schema resolution rule by rule, identity of schemas, versions side by side."""

import json

import pytest
from pyspark.sql import functions as F

from relaygauge.functions.frames import build_frame
from relaygauge.functions.text import utf8_bytes
from relaygauge.sources import catalogue, records
from relaygauge.sources.resolution import Unresolvable, canonical_form, fingerprint, resolve


def record(name="r", **fields):
    """A schema text; a field is a type, or a dict with its type and more."""
    made = [{"name": n, **(f if isinstance(f, dict) and "type" in f and ("default" in f or "aliases" in f) else {"type": f})} for n, f in fields.items()]
    return {"type": "record", "name": name, "fields": made}


def read(spark, writer, reader, body):
    """(record, problem) of one JSON body."""
    schema = catalogue.record_schema(1, json.dumps(writer))
    framed = spark.createDataFrame([(json.dumps(body),)], "body STRING").select(
        build_frame(F.lit(1), utf8_bytes(F.col("body"))).alias("value")
    )
    row = records.decode_records(records.split_frames(framed), [schema], reader=json.dumps(reader)).first()
    return row.record and row.record.asDict(True), row.problem


@pytest.mark.parametrize(
    "writer,reader,value,expected",
    [
        ("int", "long", 5, 5),
        ("int", "double", 5, 5.0),
        ("long", "float", 5, 5.0),
        ("float", "double", 0.5, 0.5),
        ("string", "bytes", "é", bytearray("é".encode())),
        ("string", "string", "x", "x"),
        ("boolean", "boolean", True, True),
        (["null", "int"], ["null", "long"], None, None),
        (["null", "int"], "long", 7, 7),
        ("int", ["null", "long"], 7, 7),
        ("null", ["null", "long"], None, None),
        ({"type": "array", "items": "int"}, {"type": "array", "items": "long"}, [1, 2], [1, 2]),
        ({"type": "map", "values": "int"}, {"type": "map", "values": "double"}, {"a": 1}, {"a": 1.0}),
        ({"type": "long", "logicalType": "timestamp-millis"}, "double", 3, 3.0),
        (record("in", a="int", b="string"), record("in", b="string", a="long"), {"a": 1, "b": "x"}, {"b": "x", "a": 1}),
        ({"type": "array", "items": record("in", a="int")}, {"type": "array", "items": record("in", a="long")}, [{"a": 1}], [{"a": 1}]),
    ],
)
def test_types_that_fit(spark, writer, reader, value, expected):
    assert read(spark, record(x=writer), record(x=reader), {"x": value}) == ({"x": expected}, None)


@pytest.mark.parametrize(
    "writer,reader,why",
    [
        ("long", "int", "x: long cannot become int"),
        ("string", "long", "x: string cannot become long"),
        ("double", "float", "x: double cannot become float"),
        ("null", "long", "x: null cannot become long"),
        ("long", "null", "x: long cannot become null"),
        ("int", {"type": "array", "items": "int"}, "x: int cannot become array"),
        ({"type": "array", "items": "string"}, {"type": "array", "items": "long"}, "x[]: string cannot become long"),
        ({"type": "map", "values": "string"}, {"type": "map", "values": "long"}, "x{}: string cannot become long"),
        (record("in", a="string"), record("in", a="long"), "x.a: string cannot become long"),
        (record("in", a="long"), record("other", a="long"), "x: in is not other"),
        (["int", "string"], "string", "x: a union is of null and one type"),
    ],
)
def test_types_that_do_not_fit_are_told_beforehand(writer, reader, why):
    with pytest.raises(Unresolvable, match=why.replace("[", r"\[").replace("]", r"\]")):
        resolve(record(x=writer), record(x=reader))


def test_records_that_do_not_fit_are_set_aside(spark):
    assert read(spark, record(x="string"), record(x="long"), {"x": "5"}) == (None, "x: string cannot become long")
    assert read(spark, record(x=["null", "long"]), record(x="long"), {"x": None}) == (None, "x: null")
    inner = {"type": "array", "items": ["null", "int"]}
    assert read(spark, record(x=inner), record(x={"type": "array", "items": "int"}), {"x": [1, None]}) == (None, "x[]: null")
    assert read(spark, record(x=record("in", a=["null", "int"])), record(x=record("in", a="int")), {"x": {}}) == (None, "x.a: null")
    assert read(spark, record(y="long"), record(x="long"), {"y": 1}) == (None, "x: missing, and has no default")


def test_defaults_aliases_and_left_out_fields(spark):
    reader = record(
        a={"type": "long", "aliases": ["old", "older"]},
        text={"type": "string", "default": "d"},
        none={"type": ["null", "long"], "default": None},
        number={"type": ["double", "null"], "default": 1},
        raw={"type": "bytes", "default": "ÿ\u0001"},
        flag={"type": "boolean", "default": False},
        list={"type": {"type": "array", "items": "int"}, "default": [1, 2]},
        map={"type": {"type": "map", "values": "string"}, "default": {}},
        inner={"type": record("in", b="long"), "default": {"b": 3}},
    )
    found, problem = read(spark, record(older="int", extra="string"), reader, {"older": 4, "extra": "x"})
    assert problem is None
    assert found == {
        "a": 4, "text": "d", "none": None, "number": 1.0, "raw": bytearray(b"\xff\x01"), "flag": False,
        "list": [1, 2], "map": {}, "inner": {"b": 3},
    }


def test_record_names_meet_by_alias_and_without_namespace(spark):
    reader = {**record("new", x="long"), "aliases": ["space.r"]}
    assert read(spark, {**record("r", x="int"), "namespace": "other"}, reader, {"x": 1}) == ({"x": 1}, None)
    assert read(spark, record("r", x="int"), record("s", x="int"), {"x": 1}) == (None, "record: r is not s")


def test_canonical_form():
    plain = {"type": "record", "name": "a.b.R", "fields": [{"name": "x", "type": ["null", "long"]}, {"name": "y", "type": {"type": "array", "items": "a.b.R"}}]}
    rich = {
        "fields": [
            {"type": ["null", {"type": "long"}], "default": None, "name": "x", "doc": "d"},
            {"name": "y", "aliases": ["z"], "type": {"items": "R", "type": "array"}},
        ],
        "doc": "text",
        "namespace": "a.b",
        "type": "record",
        "name": "R",
    }
    assert canonical_form(rich) == canonical_form(plain)
    assert canonical_form(plain).startswith('{"name":"a.b.R","type":"record","fields":[{"name":"x","type":["null","long"]}')
    assert fingerprint('"string"') == fingerprint('{"type": "string"}') != fingerprint('"bytes"')
    assert fingerprint(json.dumps(rich)) != fingerprint(json.dumps({**rich, "name": "S"}))


def test_versions_of_one_name_decode_side_by_side(spark):
    first, second = json.dumps(record("counter", k="int")), json.dumps(record("counter", n="long", unit="string"))
    laid_out = json.dumps({**json.loads(first), "doc": "the first one"}, indent=2)
    texts = [("a", first), ("b", second), ("c", laid_out), ("d", '{"type":"string","name":"label"}'), ("e", "junk")]
    known = catalogue.catalogue(spark.createDataFrame(texts, "origin STRING, value STRING"))
    with pytest.raises(ValueError, match="counter has 2 versions"):
        catalogue.record_schemas(known, {"counter": 1})
    with pytest.raises(ValueError, match="one schema"):
        catalogue.record_schemas(known, {fingerprint(first): 1, fingerprint(second): 1})
    schemas = catalogue.record_schemas(known, {fingerprint(first): 1, fingerprint(second): 2, "label": 3})
    assert [s.schema_id for s in schemas] == [1, 2, 3]
    rows = [(1, '{"k": 5}'), (2, '{"n": 6, "unit": "s"}'), (3, "text"), (9, "{}")]
    framed = spark.createDataFrame(rows, "id INT, body STRING").select(build_frame(F.col("id"), utf8_bytes(F.col("body"))).alias("value"))
    reader = json.dumps(record("counter", n={"type": "long", "aliases": ["k"]}, unit={"type": "string", "default": "none"}))
    found = records.decode_records(records.split_frames(framed), schemas, reader=reader)
    assert [(r.record and tuple(r.record), r.text, r.problem) for r in found.orderBy("schema_id").collect()] == [
        ((5, "none"), None, None),
        ((6, "s"), None, None),
        (None, "text", None),
        (None, None, "unknown schema"),
    ]


def test_a_reader_needs_definitions():
    from pyspark.sql.types import LongType, StructField, StructType

    schema = records.RecordSchema(1, "r", fields=StructType([StructField("x", LongType())]))
    with pytest.raises(ValueError, match="definition"):
        records._readings([schema], None, json.dumps(record(x="long")))
    with pytest.raises(ValueError, match="target"):
        records._readings([schema], None, None)
