"""Records of one schema read as another: the rules for writer and reader schemas, as column expressions.

Schemas are parsed schema texts.  What can be told from the schemas alone is settled when the expression
is made; what depends on a value, as a null where the reader has none, comes as a problem of its row.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from relaygauge.functions.text import utf8_bytes, utf8_text
from relaygauge.sources.catalogue import PLAIN_TYPES, field_type

# What a plain type of the writer may become, besides itself.
PROMOTIONS = {
    "int": {"long", "float", "double"},
    "long": {"float", "double"},
    "float": {"double"},
    "string": {"bytes"},
    "bytes": {"string"},
}
# What the canonical form of a schema keeps, in this order.
CANONICAL = ("name", "type", "fields", "symbols", "items", "values", "size")
NAMED = {"record", "enum", "fixed"}


class Unresolvable(ValueError):
    """The reader's schema has no place for what the writer's has."""


def canonical_form(schema, namespace: str | None = None) -> str:
    """A schema text without what does not change what is written: full names, plain types as texts, no docs, defaults, aliases."""
    return json.dumps(_canonical(schema, namespace), separators=(",", ":"), ensure_ascii=False)


def _canonical(schema, namespace: str | None):
    if isinstance(schema, list):
        return [_canonical(s, namespace) for s in schema]
    if isinstance(schema, str):
        return schema if schema in PLAIN_TYPES or schema == "null" else _full_name(schema, namespace)
    kind = schema["type"]
    if kind not in NAMED and kind not in ("array", "map"):
        return _canonical(kind, namespace)
    own = dict(schema)
    if kind in NAMED:
        own["name"] = _full_name(schema["name"], schema.get("namespace", namespace))
        namespace = own["name"].rpartition(".")[0] or None
    if kind == "record":
        own["fields"] = [{"name": f["name"], "type": _canonical(f["type"], namespace)} for f in schema["fields"]]
    for inner in ("items", "values"):
        if inner in own:
            own[inner] = _canonical(own[inner], namespace)
    return {key: own[key] for key in CANONICAL if key in own}


def _full_name(name: str, namespace: str | None) -> str:
    return name if "." in name or not namespace else f"{namespace}.{name}"


def fingerprint(definition: str) -> str:
    """sha256 of the canonical form of a schema text: the same for texts that write the same."""
    return hashlib.sha256(canonical_form(json.loads(definition)).encode()).hexdigest()


@dataclass(frozen=True)
class Resolution:
    """How a column of the writer's type becomes one of the reader's, and what is wrong with a value, if anything.

    ``problem`` is None where nothing can be.
    """

    column: Callable[[Column], Column]
    problem: Callable[[Column], Column] | None = None


def resolve(writer, reader, path: str = "") -> Resolution:
    """The expression that reads a writer's values as the reader's schema has them.

    Numbers widen, strings and bytes are read as each other.  Fields meet by name or by the reader's aliases; one that the writer
    lacks has its default, and one that the reader lacks is left out.  A union is of null and one
    type; a null where the reader takes none is a problem.  ``Unresolvable`` says where the schemas do not fit.
    """
    reader_nulls, wanted = _union(reader, path)
    writer_nulls, given = _union(writer, path)
    if given is None:
        if not reader_nulls:
            raise Unresolvable(f"{_at(path)}: null cannot become {_name(wanted)}")
        kind = field_type("null" if wanted is None else wanted)
        return Resolution(lambda value: F.lit(None).cast(kind))
    if wanted is None:
        raise Unresolvable(f"{_at(path)}: {_name(given)} cannot become null")
    own = _resolve_one(given, wanted, path)
    if not writer_nulls or reader_nulls:
        return own

    def problem(value: Column) -> Column:
        inner = own.problem(value) if own.problem else F.lit(None).cast("string")
        return F.when(value.isNull(), F.lit(f"{_at(path)}: null")).otherwise(inner)

    return Resolution(own.column, problem)


def _union(schema, path: str):
    """Whether a type admits null, and its other type."""
    if not isinstance(schema, list):
        return schema == "null", None if schema == "null" else schema
    others = [s for s in schema if s != "null"]
    if len(others) > 1:
        raise Unresolvable(f"{_at(path)}: a union is of null and one type")
    return "null" in schema, others[0] if others else None


def _at(path: str) -> str:
    return path or "record"


def _name(schema) -> str:
    kind = schema if isinstance(schema, str) else schema["type"] if isinstance(schema, dict) else "union"
    return kind if isinstance(kind, str) else _name(kind)


def _plain(schema):
    """A type that stands in an object of its own, as {"type": "long", "logicalType": ...}."""
    while isinstance(schema, dict) and not isinstance(schema["type"], list) and schema["type"] not in (*NAMED, "array", "map"):
        schema = schema["type"]
    return schema


def _resolve_one(writer, reader, path: str) -> Resolution:
    writer, reader = _plain(writer), _plain(reader)
    have, want = _name(writer), _name(reader)
    if have in PLAIN_TYPES and want in PLAIN_TYPES:
        if have == want:
            return Resolution(lambda value: value)
        if want not in PROMOTIONS.get(have, ()):
            raise Unresolvable(f"{_at(path)}: {have} cannot become {want}")
        if want == "bytes":
            return Resolution(utf8_bytes)
        if want == "string":
            return Resolution(utf8_text)
        return Resolution(lambda value: value.cast(PLAIN_TYPES[want]))
    if have != want:
        raise Unresolvable(f"{_at(path)}: {have} cannot become {want}")
    if have == "record":
        return _record(writer, reader, path)
    if have == "array":
        inner = resolve(writer["items"], reader["items"], f"{path}[]")
        return Resolution(
            lambda value: F.transform(value, inner.column),
            inner.problem and (lambda value: _any(F.transform(value, inner.problem))),
        )
    if have == "map":
        inner = resolve(writer["values"], reader["values"], f"{path}{{}}")
        return Resolution(
            lambda value: F.transform_values(value, lambda _, v: inner.column(v)),
            inner.problem and (lambda value: _any(F.transform(F.map_values(value), inner.problem))),
        )
    raise Unresolvable(f"{_at(path)}: {have} is not read")


def _any(problems: Column) -> Column:
    """The first problem of an array of them, or null."""
    return F.get(F.filter(problems, lambda p: p.isNotNull()), F.lit(0))


def _record(writer: dict, reader: dict, path: str) -> Resolution:
    names = [_short(reader["name"]), *(_short(a) for a in reader.get("aliases", ()))] if "name" in reader else []
    if names and "name" in writer and _short(writer["name"]) not in names:
        raise Unresolvable(f"{_at(path)}: {writer['name']} is not {reader['name']}")
    given = {f["name"]: f["type"] for f in writer["fields"]}
    parts: list[tuple[str, Callable[[Column], Column]]] = []
    problems: list[Callable[[Column], Column]] = []
    for field in reader["fields"]:
        name, place = field["name"], f"{path}.{field['name']}" if path else field["name"]
        source = next((n for n in [name, *field.get("aliases", ())] if n in given), None)
        if source is None:
            if "default" not in field:
                raise Unresolvable(f"{place}: missing, and has no default")
            constant = default_value(field["type"], field["default"])
            parts.append((name, lambda value, constant=constant: constant))
            continue
        inner = resolve(given[source], field["type"], place)
        parts.append((name, lambda value, inner=inner, source=source: inner.column(value[source])))
        if inner.problem:
            problems.append(lambda value, inner=inner, source=source: inner.problem(value[source]))

    def column(value: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(*[part(value).alias(name) for name, part in parts]))

    def problem(value: Column) -> Column:
        return F.when(value.isNotNull(), F.coalesce(*[p(value) for p in problems]))

    return Resolution(column, problem if problems else None)


def _short(name: str) -> str:
    return name.rpartition(".")[2]


def default_value(schema, default) -> Column:
    """A field's default as a constant of the field's type; that of a union is of its first type."""
    kind = field_type(schema)
    if default is None:
        return F.lit(None).cast(kind)
    plain = _plain(schema[0] if isinstance(schema, list) else schema)
    if plain == "bytes":
        return F.unhex(F.lit(default.encode("latin-1").hex()))
    if isinstance(plain, str):
        return F.lit(default).cast(kind)
    return F.from_json(F.lit(json.dumps(default)), kind)
