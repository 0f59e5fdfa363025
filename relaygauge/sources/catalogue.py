"""Catalogues of record schemas, from schema files or texts."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    DataType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
)

from relaygauge.sources.records import RecordSchema

_FINGERPRINT = re.compile("[0-9a-f]{64}")

# The plain types of a schema text.
PLAIN_TYPES = {
    "boolean": BooleanType(),
    "int": IntegerType(),
    "long": LongType(),
    "float": FloatType(),
    "double": DoubleType(),
    "bytes": BinaryType(),
    "string": StringType(),
}


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The schemas in one file or in all files below a directory."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return catalogue(files.select(F.col("_metadata.file_path").alias("origin"), "value"))


def catalogue(texts: DataFrame) -> DataFrame:
    """(origin, name, namespace, kind, fields, definition) for schema texts (origin, value).

    A text that is no JSON object has a null name and kind.
    """
    parts = F.from_json(
        "value", "name STRING, namespace STRING, type STRING, fields ARRAY<STRUCT<name: STRING>>"
    )
    return texts.select("origin", parts.alias("_schema"), F.col("value").alias("definition")).select(
        "origin",
        F.col("_schema.name").alias("name"),
        F.col("_schema.namespace").alias("namespace"),
        F.col("_schema.type").alias("kind"),
        F.col("_schema.fields.name").alias("fields"),
        "definition",
    )


def field_type(kind) -> DataType:
    """The column type of a schema's type: plain, array, map, record, or a union with null."""
    if isinstance(kind, list):
        others = [k for k in kind if k != "null"]
        if len(others) != 1:
            raise ValueError(f"a union is of one type and null, not {kind}")
        return field_type(others[0])
    if isinstance(kind, dict):
        if kind["type"] == "array":
            return ArrayType(field_type(kind["items"]))
        if kind["type"] == "map":
            return MapType(StringType(), field_type(kind["values"]))
        if kind["type"] == "record":
            return StructType([StructField(f["name"], field_type(f["type"])) for f in kind["fields"]])
        return field_type(kind["type"])
    if kind == "null":
        return StringType()  # of which there is no value
    if kind not in PLAIN_TYPES:
        raise ValueError(f"unknown type {kind!r}")
    return PLAIN_TYPES[kind]


def record_schema(schema_id: int, definition: str, required: str | None = None) -> RecordSchema:
    """A schema text as what ``decode_records`` takes."""
    parsed = json.loads(definition)
    kind = parsed if isinstance(parsed, str) else parsed["type"]
    name = kind if isinstance(parsed, str) else parsed.get("name", kind)
    if kind == "record":
        return RecordSchema(schema_id, name, fields=field_type(parsed), required=required, definition=definition)
    return RecordSchema(schema_id, name, kind, definition=definition)


def record_schemas(known: DataFrame, ids: Mapping[str, int]) -> list[RecordSchema]:
    """The schemas of a catalogue that ``ids`` gives an id to: a row per schema text of their names is gathered.

    A schema is named by its name, or by the fingerprint of its canonical form where the catalogue has several versions
    of a name; a name that stands for two of them is an error, and so is an id for two schemas.
    """
    from relaygauge.sources.resolution import fingerprint

    if len(set(ids.values())) < len(ids):
        raise ValueError("an id belongs to one schema")
    prints = [k for k in ids if _FINGERPRINT.fullmatch(k)]
    rows = known.where(F.col("kind").isNotNull()) if prints else known.where(F.col("name").isin(*ids))
    versions: dict[str, dict[str, str]] = {}
    for row in sorted(rows.select("name", "definition").distinct().collect(), key=lambda r: r["definition"]):
        # Texts that differ in layout, documentation or defaults only are one version.
        versions.setdefault(row["name"], {}).setdefault(fingerprint(row["definition"]), row["definition"])
    by_print = {p: text for found in versions.values() for p, text in found.items()}
    schemas = []
    for key, number in ids.items():
        if key in by_print:
            schemas.append(record_schema(number, by_print[key]))
        elif len(versions.get(key, {})) > 1:
            raise ValueError(f"{key} has {len(versions[key])} versions; name them by their fingerprints {sorted(versions[key])}")
        elif key in versions:
            schemas.append(record_schema(number, *versions[key].values()))
    return sorted(schemas, key=lambda s: s.name)
