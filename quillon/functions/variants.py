"""JSON values: three ways to write them, a list or an object by key, and sketches of their shape."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: How JSON is written. compact keeps the keys' order; sorted and plain put a space after separators, plain escapes what isn't ASCII.
STYLES = {"compact": {"ensure_ascii": False, "separators": (",", ":")}, "sorted": {"ensure_ascii": False, "sort_keys": True}, "plain": {}}
#: How many keys of an object and levels of nesting a sketch goes into.
KEYS, LEVELS = 12, 3


def written(text: Column, style: str) -> Column:
    """JSON text written anew in a style, in Arrow batches; a JSON string gives its own text, what isn't JSON (or null) null."""
    options = STYLES[style]

    @F.pandas_udf(StringType())
    def of(x: pd.Series) -> pd.Series:
        def one(s: str | None) -> str | None:
            try:
                v = json.loads(s)
            except (TypeError, ValueError, RecursionError):
                return None
            return v if isinstance(v, str) else json.dumps(v, **options)

        return x.map(one)

    return of(text)


def by_key(value: Column) -> Column:
    """A variant that is an object, or a list of objects, as a map to variants: objects by their own keys, a list's objects by id, else name, else place; all else an empty map."""
    name = lambda v, key: F.try_variant_get(v, f"$.{key}", "string")
    entries = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v, i: F.struct(F.coalesce(name(v, "id"), name(v, "name"), i.cast("string")).alias("key"), v.alias("value")))
    objects = F.filter(entries, lambda e: F.schema_of_variant(e["value"]).startswith("OBJECT"))
    listed = F.map_from_entries(F.filter(objects, lambda e, i: ~F.exists(F.slice(objects, i + 2, F.size(objects)), lambda o: o["key"] == e["key"])))  # of one key's the last
    return F.when(F.schema_of_variant(value).startswith("ARRAY"), listed).when(F.schema_of_variant(value).startswith("OBJECT"), F.try_variant_get(value, "$", "map<string,variant>")).otherwise(F.map_from_entries(F.array().cast("array<struct<key:string,value:variant>>")))


def sketch(text: Column) -> Column:
    """The shape of one JSON value: objects' first keys, a list as its length and first element, nothing deeper than LEVELS; leaves as they are."""
    def shape(x, level: int = 0):
        if isinstance(x, dict):
            return {k: shape(v, level + 1) if level < LEVELS else type(v).__name__ for k, v in list(x.items())[:KEYS]}
        if isinstance(x, list):
            return [len(x), shape(x[0], level + 1)] if x else []
        return x

    @F.pandas_udf(StringType())
    def of(x: pd.Series) -> pd.Series:
        def one(s: str | None) -> str | None:
            try:
                return json.dumps(shape(json.loads(s)), ensure_ascii=False)
            except (TypeError, ValueError, RecursionError):
                return None

        return x.map(one)

    return of(text)


def schema(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """(by, n, schema): the one schema that all of a group's variants fit, merged on both sides of the shuffle."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.schema_of_variant_agg(value).alias("schema"))
