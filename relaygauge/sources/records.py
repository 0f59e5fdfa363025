"""Framed and multi-schema records.

Bodies are decoded by a callable ``Column, RecordSchema -> Column``: ``json_body`` works
everywhere, ``avro_body`` where Spark's Avro package is deployed.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructField, StructType

from relaygauge.functions.frames import frame_body, frame_problem, frame_schema_id
from relaygauge.functions.text import utf8_text
from relaygauge.functions.timings import timings_from_map
from relaygauge.schemas import TIMINGS


@dataclass(frozen=True)
class RecordSchema:
    """A writer schema: a record of ``fields``, or plain ``bytes`` or ``string``."""

    schema_id: int
    name: str
    kind: str = "record"
    fields: StructType | None = None
    required: str | None = None
    definition: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in ("record", "bytes", "string"):
            raise ValueError(f"unknown schema kind {self.kind!r}")
        if self.kind == "record" and not self.fields:
            raise ValueError("a record schema needs fields")


CORRUPT = "_corrupt"
Decoder = Callable[[Column, RecordSchema], Column]


def json_body(body: Column, schema: RecordSchema) -> Column:
    """Fields may be null; a body that is no such record is marked, not taken for nulls."""
    marked = StructType([*schema.fields.fields, StructField(CORRUPT, StringType())])
    return F.from_json(utf8_text(body), marked, {"columnNameOfCorruptRecord": CORRUPT})


def avro_body(body: Column, schema: RecordSchema) -> Column:
    from pyspark.sql.avro.functions import from_avro

    if not schema.definition:
        raise ValueError("the Avro decoder needs the schema's definition")
    return from_avro(body, schema.definition, {"mode": "PERMISSIVE"})


def split_frames(values: DataFrame, value: str = "value") -> DataFrame:
    """Rows with ``schema_id`` and ``body``, or the ``problem`` that makes them no frame."""
    column = F.col(value)
    return values.select(
        "*",
        frame_schema_id(column).alias("schema_id"),
        frame_body(column).alias("body"),
        frame_problem(column).alias("problem"),
    )


def conform(record: Column, source: StructType, target: StructType) -> Column:
    """A decoded record as the target struct: fields by name, absent ones null."""

    def field(name: str, kind) -> Column:
        if name not in source.names:
            return F.lit(None).cast(kind)
        own = record[name]
        if kind == TIMINGS and isinstance(source[name].dataType, MapType):
            return timings_from_map(own)
        return own.cast(kind)

    return F.struct(*[field(f.name, f.dataType).alias(f.name) for f in target.fields])


def decode_records(
    framed: DataFrame,
    schemas: Sequence[RecordSchema],
    target: StructType | None = None,
    decode: Decoder = json_body,
    reader: str | None = None,
) -> DataFrame:
    """Split frames decoded by their writer schema.

    Records come as ``target``, fields by name and absent ones null; or, by the rules of schema
    resolution, as the schema text ``reader`` has them, and those that do not fit it are set aside.

    ``schemas`` are the known ones, a few; their names go into the plan, so no message is joined.
    Adds ``name`` and ``kind`` of the schema, ``record`` for record schemas, ``text`` for string and
    ``bytes`` for byte schemas; what cannot be decoded keeps its row and gets a ``problem``.
    """
    target, readings = _readings(schemas, target, reader)
    known = F.lit(None).cast("struct<name:string,kind:string>")
    for schema in schemas:
        own = F.struct(F.lit(schema.name).alias("name"), F.lit(schema.kind).alias("kind"))
        known = F.when(F.col("schema_id") == schema.schema_id, own).otherwise(known)
    rows = framed.withColumn("_known", known).withColumns(
        {"name": F.col("_known.name"), "kind": F.col("_known.kind")}
    ).drop("_known")
    body, kind = F.col("body"), F.col("kind")
    by_id = {s.schema_id: s for s in schemas if s.kind == "record"}
    rows = rows.withColumns(
        {f"_decoded{i}": F.when(F.col("schema_id") == i, decode(body, s)) for i, s in by_id.items()}
    )
    read = F.lit(None).cast(StructType([StructField("record", target), StructField("misfit", StringType())]))
    for i, schema in by_id.items():
        own = F.col(f"_decoded{i}")
        read = F.when(_fits(own, decode, schema.required), readings[i](own)).otherwise(read)
    decoded = evaluated_once(rows, "_read", read).drop(*[f"_decoded{i}" for i in by_id])
    decoded = decoded.withColumns({"record": F.col("_read.record"), "_misfit": F.col("_read.misfit")}).drop("_read")
    decoded = decoded.withColumns(
        {"text": F.when(kind == "string", utf8_text(body)), "bytes": F.when(kind == "bytes", body)}
    )
    problem = (
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.col("name").isNull(), F.lit("unknown schema"))
        .when(F.col("_misfit").isNotNull(), F.col("_misfit"))
        .when((kind == "record") & F.col("record").isNull(), F.lit("undecodable"))
    )
    return decoded.withColumn("problem", problem).drop("_misfit")


def _readings(
    schemas: Sequence[RecordSchema], target: StructType | None, reader: str | None
) -> tuple[StructType, dict[int, Callable[[Column], Column]]]:
    """The type that records come as, and how those of each schema id become (record, misfit)."""
    records = [s for s in schemas if s.kind == "record"]
    if reader is None:
        if target is None:
            raise ValueError("records need a target type or a reader schema")

        def conformed(schema: RecordSchema) -> Callable[[Column], Column]:
            return lambda own: F.struct(
                conform(own, schema.fields, target).alias("record"), F.lit(None).cast("string").alias("misfit")
            )

        return target, {s.schema_id: conformed(s) for s in records}

    # The catalogue makes schemas of this module's kind.
    from relaygauge.sources.catalogue import field_type
    from relaygauge.sources.resolution import Unresolvable, resolve

    wanted = json.loads(reader)
    target = field_type(wanted)

    def resolved(schema: RecordSchema) -> Callable[[Column], Column]:
        if not schema.definition:
            raise ValueError("to be read by a reader schema a schema needs its definition")
        nothing = F.lit(None).cast(target)
        try:
            found = resolve(json.loads(schema.definition), wanted)
        except Unresolvable as error:
            misfit = str(error)
            return lambda own: F.struct(nothing.alias("record"), F.lit(misfit).alias("misfit"))

        def read(own: Column) -> Column:
            problem = found.problem(own) if found.problem else F.lit(None).cast("string")
            record = F.when(problem.isNull(), found.column(own).cast(target))
            return F.struct(record.alias("record"), problem.alias("misfit"))

        return read

    return target, {s.schema_id: resolved(s) for s in records}


def evaluated_once(rows: DataFrame, name: str, column: Column) -> DataFrame:
    """``rows`` with a costly column that later filters refer to, not repeat.

    Spark moves filters below a projection and puts the column's expression in for each mention
    of it; a body would be parsed many times.  It does not move them below a generator.
    """
    return rows.select("*", F.explode_outer(F.array(column)).alias(name))


def _fits(decoded: Column, decode: Decoder, required: str | None) -> Column:
    """Whether a value was such a record; a field that is ``required`` must not be null."""
    whole = decoded.isNotNull() & (decoded[CORRUPT].isNull() if decode is json_body else F.lit(True))
    return whole & decoded[required].isNotNull() if required else whole


def decode_with_fallback(
    values: DataFrame,
    schemas: Sequence[RecordSchema],
    target: StructType,
    value: str = "value",
    decode: Decoder = json_body,
) -> DataFrame:
    """Each value decoded by the first of the schemas that fits it, chosen row by row.

    A schema fits a record that has its ``required`` field, or its first one if it names none.
    Adds ``schema`` (null if none fits) and ``record``.  A schema is tried only on values that
    none before it fits.
    """
    if not schemas:
        raise ValueError("no schemas given")
    tried, rows = F.lit(False), values
    name, record = F.lit(None).cast("string"), F.lit(None).cast(target)
    for i, schema in enumerate(schemas):
        own = F.col(f"_decoded{i}")
        fits = _fits(own, decode, schema.required or schema.fields.names[0])
        rows = rows.withColumn(f"_decoded{i}", F.when(~tried, decode(F.col(value), schema)))
        tried = tried | F.coalesce(fits, F.lit(False))
        name = F.coalesce(name, F.when(fits, F.lit(schema.name)))
        record = F.coalesce(record, F.when(fits, conform(own, schema.fields, target)))
    chosen = F.struct(name.alias("schema"), record.alias("record"))
    return evaluated_once(rows, "_chosen", chosen).select(*values.columns, "_chosen.*")
