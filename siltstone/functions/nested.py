"""Rewriting of the strings inside nested values, directed by their type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import absolute_paths_masked, redacted

#: A JSON string, with the colon that makes it a key.
_STRING = r'"(?:[^"\\]|\\.)*"\s*:?'


def _in_variant(v: Column, change: Callable[[Column], Column]) -> Column:
    """v with its string values changed, its keys as they are: string by string of its JSON text."""
    text = F.to_json(v)

    def one(s: Column) -> Column:
        value = F.try_variant_get(F.try_parse_json(s), "$", "string")
        quoted = F.to_json(F.struct(change(value).alias("v")))
        return F.when(s.endswith(":"), s).otherwise(F.substring(quoted, F.lit(6), F.length(quoted) - 6))

    strings = F.transform(F.regexp_extract_all(text, F.lit(_STRING), F.lit(0)), one)
    between = F.split(text, _STRING)
    return F.try_parse_json(F.array_join(F.zip_with(between, strings, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""))


def rewritten(c: Column, kind: T.DataType, change: Callable[[Column], Column]) -> Column:
    """c with every string in it changed, at any depth of structs, arrays, maps (their values) and variants; nulls stay."""
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return F.when(c.isNotNull(), change(c))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: rewritten(x, kind.elementType, change))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, x: rewritten(x, kind.valueType, change))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[rewritten(c.getField(f.name), f.dataType, change).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.VariantType):
        return F.when(c.isNotNull(), _in_variant(c, change))
    return c


def cleaned(c: Column) -> Column:
    """A text without secrets and absolute paths."""
    return absolute_paths_masked(redacted(c))


def cleaned_rows(df: DataFrame) -> DataFrame:
    """df with every string in it cleaned, at any depth."""
    return df.select(*[rewritten(F.col(f"`{f.name}`"), f.dataType, cleaned).alias(f.name) for f in df.schema.fields])
