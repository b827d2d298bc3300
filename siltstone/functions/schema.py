"""JSON Schemas as data: a schema becomes one expression over a variant that lists what is wrong, with paths.

Compiled keywords: type, enum, const, required, properties, additionalProperties
(false, or a schema), minLength, maxLength, pattern, minimum, maximum, minItems,
maxItems, items. Keywords that only describe are passed over; any other is an
error when the schema is compiled, so that no rule is left out in silence. Types
are JSON's own: a number in a string is a string, and 1.0 is an integer.

Errors read `$.topics[2]: maxLength`; a missing key `$.reason: required`, a key
too many `$.extra: additionalProperties`, unreadable JSON `$: json`. They come in
the order of the schema, extra keys by name.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from importlib import resources

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

DESCRIBING = {"$schema", "$id", "title", "description", "default", "examples", "strict", "name"}
_NONE = "array<string>"


def from_file(spark: SparkSession, path: str) -> dict:
    """A schema, or that of a tool (its input_schema), from a JSON file that Spark can read."""
    said = json.loads("".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect()))
    return said.get("input_schema", said)


def packaged(name: str) -> dict:
    """A schema that comes with the library."""
    said = json.loads(resources.files("siltstone").joinpath("schemas", f"{name}.json").read_text())
    return said.get("input_schema", said)


def _once(value: Column, made: Callable[[Column], Column]) -> Column:
    """What is made of a value that is computed once for a row, however often it is named."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def _is(v: Column, shape: Column, kind: str) -> Column:
    number = shape.isin("BIGINT", "DOUBLE", "FLOAT") | shape.startswith("DECIMAL")
    return {
        "string": shape == "STRING",
        "boolean": shape == "BOOLEAN",
        "null": F.is_variant_null(v),
        "number": number,
        "integer": number & (F.try_variant_get(v, "$", "double") % 1 == 0),
        "object": shape.startswith("OBJECT"),
        "array": shape.startswith("ARRAY"),
    }[kind]


def _literal(value: object) -> Column:
    return F.lit(json.dumps(value, sort_keys=True, separators=(",", ":")))


def _errors(v: Column, schema: dict, path: Column) -> Column:
    """What is wrong with v, which is there (if null: JSON's null)."""

    def typed(shape: Column) -> Column:
        if not schema.keys() & {"required", "properties", "additionalProperties"}:
            return _listed(v, shape, None, schema, path)
        return _once(F.when(_is(v, shape, "object"), F.try_variant_get(v, "$", "map<string,variant>")), lambda fields: _listed(v, shape, fields, schema, path))

    return _once(F.schema_of_variant(v), typed)


def _listed(v: Column, shape: Column, fields: Column | None, schema: dict, path: Column) -> Column:
    unknown = schema.keys() - DESCRIBING - {"type", "enum", "const", "required", "properties", "additionalProperties", "minLength", "maxLength", "pattern", "minimum", "maximum", "minItems", "maxItems", "items"}
    if unknown:
        raise ValueError(f"keywords without a rule: {sorted(unknown)}")
    none, parts = F.array().cast(_NONE), []

    def rule(name: str, broken: Column) -> None:
        parts.append(F.when(F.coalesce(broken, F.lit(False)), F.array(F.concat(path, F.lit(f": {name}")))).otherwise(none))

    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds:
        fits = F.lit(False)
        for k in kinds:
            fits = fits | _is(v, shape, k)
        rule("type", ~fits)
    for word, values in (("enum", schema.get("enum")), ("const", [schema["const"]] if "const" in schema else None)):
        if values is not None:
            rule(word, ~F.to_json(v).isin(*[_literal(x) for x in values]))
    text = F.when(_is(v, shape, "string"), F.try_variant_get(v, "$", "string"))
    number = F.when(_is(v, shape, "number"), F.try_variant_get(v, "$", "double"))
    items = F.when(_is(v, shape, "array"), F.try_variant_get(v, "$", "array<variant>"))
    for word, broken in {
        "minLength": lambda x: F.length(text) < x, "maxLength": lambda x: F.length(text) > x, "pattern": lambda x: ~text.rlike(x),
        "minimum": lambda x: number < x, "maximum": lambda x: number > x, "minItems": lambda x: F.size(items) < x, "maxItems": lambda x: F.size(items) > x,
    }.items():
        if word in schema:
            rule(word, broken(schema[word]))
    if "items" in schema:
        each = F.transform(items, lambda x, i: _errors(x, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        parts.append(F.coalesce(F.flatten(each), none))
    named = schema.get("properties", {})
    for key in [*named, *[k for k in schema.get("required", []) if k not in named]]:
        held, own = F.map_contains_key(fields, key), F.concat(path, F.lit(f".{key}"))
        if key in schema.get("required", []):
            parts.append(F.when(F.coalesce(~held, F.lit(False)), F.array(F.concat(own, F.lit(": required")))).otherwise(none))
        if key in named:
            parts.append(F.when(F.coalesce(held, F.lit(False)), _once(F.try_element_at(fields, F.lit(key)), lambda x: _errors(x, named[key], own))).otherwise(none))
    more = schema.get("additionalProperties", True)
    if more is not True:
        extra = F.array_sort(F.array_except(F.map_keys(fields), F.array(*[F.lit(k) for k in named]).cast(_NONE)))
        if more is False:
            wrong = F.transform(extra, lambda k: F.concat(path, F.lit("."), k, F.lit(": additionalProperties")))
        else:
            wrong = F.flatten(F.transform(extra, lambda k: _once(F.try_element_at(fields, k), lambda x: _errors(x, more, F.concat(path, F.lit("."), k)))))
        parts.append(F.coalesce(wrong, none))
    return F.concat(*parts) if parts else none


def violations(text: Column, schema: dict) -> Column:
    """The errors of a JSON text, an array of strings; empty if it conforms. Null and unreadable texts are `$: json`."""
    return _once(F.try_parse_json(text), lambda v: F.when(v.isNull(), F.array(F.lit("$: json"))).otherwise(_errors(v, schema, F.lit("$"))))
