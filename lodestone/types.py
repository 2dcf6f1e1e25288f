"""Declared type names, their categories and their Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from .errors import require

STRINGS = ("string", "text", "varchar", "char", "citext", "uuid")
INTEGERS = ("integer", "int", "bigint", "smallint")
DECIMALS = ("decimal", "numeric", "money", "number")
FLOATS = ("float", "double", "real")
WALL_TIMES = ("datetime", "naive_datetime", "timestamp")
INSTANTS = ("utc_datetime", "timestamptz")

CATEGORIES = (
    {n: "string" for n in STRINGS}
    | {n: "integer" for n in INTEGERS}
    | {n: "decimal" for n in (*DECIMALS, *FLOATS)}
    | {"boolean": "boolean", "date": "date"}
    | {n: "datetime" for n in (*WALL_TIMES, *INSTANTS)}
    | {"json": "json", "jsonb": "json"}
)
ARRAY_ITEMS = ("string", "integer", "decimal", "boolean", "date", "uuid")


def category(name: str | None) -> str:
    """The category that value expressions check; 'other' for the rest."""
    return CATEGORIES.get((name or "").lower(), "other")


def is_numeric(name: str | None) -> bool:
    return category(name) in ("integer", "decimal")


def is_temporal(name: str | None) -> bool:
    return bool(re.search("date|time", name or "", re.IGNORECASE))


def spark_type(name: str, items: str | None = None) -> T.DataType:
    """The Spark type that a declared type is stored as."""
    key = name.lower()
    if key == "array":
        require(items in ARRAY_ITEMS, "invalid_domain", "no such type of array items", items=items)
        return T.ArrayType(spark_type(items))
    if key in FLOATS:
        return T.DoubleType()
    if key in DECIMALS:
        return T.DecimalType(38, 10)
    if key in INSTANTS:
        return T.TimestampType()
    if key in WALL_TIMES:
        return T.TimestampNTZType()
    if key == "epoch_datetime":
        return T.LongType()
    if key == "binary":
        return T.BinaryType()
    return {
        "string": T.StringType(),
        "integer": T.LongType(),
        "boolean": T.BooleanType(),
        "date": T.DateType(),
    }.get(category(key), T.StringType())


def declared_type(kind: T.DataType) -> str:
    """The declared type of a Spark type, for introspection."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(kind, T.DecimalType):
        return "decimal"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.DateType):
        return "date"
    if isinstance(kind, T.TimestampNTZType):
        return "naive_datetime"
    if isinstance(kind, T.TimestampType):
        return "utc_datetime"
    if isinstance(kind, T.ArrayType):
        return "array"
    if isinstance(kind, T.BinaryType):
        return "binary"
    return "string"
