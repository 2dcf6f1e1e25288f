"""CSV import: inspect bounded content, or map a file of any size; then preview what an
import would do."""

from __future__ import annotations

import csv
import hashlib
import io
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import require
from ..limits import Limits

MAX_ROWS, MAX_COLUMNS, SAMPLE = 100_000, 256, 20
TRANSFORMS = ("trim", "uppercase", "lowercase", "normalize_whitespace", "empty_to_null")
BLANKS = ("omit", "empty", "null", "error")
SOURCES = ("column", "static", "parameter", "trusted")


def inspect_csv(content: bytes, delimiter: str = ",", header: bool = True, limits: Limits | None = None) -> dict[str, Any]:
    """Columns (repeated headers numbered), counts, SHA-256 and sample rows of a file
    that was uploaded."""
    limits = limits or Limits()
    limits.check("max_import_preview_bytes", len(content), "import_too_large", "import")
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        require(False, "import_encoding", "the file is no UTF-8")
        raise
    require(len(delimiter) == 1, "invalid_import", "delimiter: one character")
    rows = list(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter))
    rows = [r for r in rows if r]
    require(rows, "import_empty", "the file is empty")
    names = headers(rows[0]) if header else [f"column_{i + 1}" for i in range(len(rows[0]))]
    body = rows[1:] if header else rows
    require(len(names) <= MAX_COLUMNS, "import_too_wide", "more columns than are read", maximum=MAX_COLUMNS)
    require(len(body) <= MAX_ROWS, "import_too_long", "more rows than are read", maximum=MAX_ROWS)
    for i, r in enumerate(body):
        require(len(r) <= len(names), "import_row_width", "a row is longer than the header", row=i + 1)
        for cell in r:
            limits.check_bytes("max_result_cell_bytes", cell, "import_cell_too_large", "import cell")
    body = [r + [""] * (len(names) - len(r)) for r in body]
    return {"columns": names, "row_count": len(body), "byte_count": len(content), "sha256": hashlib.sha256(content).hexdigest(), "sample": body[:SAMPLE], "rows": body}


def headers(given: list[str]) -> list[str]:
    """Trimmed names; empty ones by place, repeated ones numbered."""
    out: list[str] = []
    counts: dict[str, int] = {}
    for i, name in enumerate(given):
        name = name.strip() or f"column_{i + 1}"
        counts[name] = counts.get(name, 0) + 1
        numbered = name if counts[name] == 1 else f"{name}_{counts[name]}"
        while numbered in out:
            counts[name] += 1
            numbered = f"{name}_{counts[name]}"
        out.append(numbered)
    return out


def read_csv(spark: SparkSession, path: str, columns: list[str], delimiter: str = ",", header: bool = True) -> DataFrame:
    """A file or folder of any size as strings, with the schema given rather than
    inferred; a malformed row fails the read."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(path, schema=schema, sep=delimiter, header=header, mode="FAILFAST", quote='"', escape='"', multiLine=True, enforceSchema=True)


def frame_of(spark: SparkSession, inspected: dict[str, Any]) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in inspected["columns"]])
    return spark.createDataFrame([tuple(r) for r in inspected["rows"]], schema)


def transformed(x: Column, steps: list[str]) -> Column:
    for s in steps:
        require(s in TRANSFORMS, "invalid_import", "no transform has this name", transform=s)
        x = {
            "trim": lambda v: F.regexp_replace(v, r"\A\s+|\s+\z", ""),
            "uppercase": F.upper,
            "lowercase": F.lower,
            "normalize_whitespace": lambda v: F.regexp_replace(F.trim(v), r"\s+", " "),
            "empty_to_null": lambda v: F.nullif(v, F.lit("")),
        }[s](x)
    return x


def _source(spec: dict[str, Any], columns: list[str], parameters: dict[str, Any], trusted: dict[str, Any]) -> Column:
    kind = spec.get("source", "column")
    require(kind in SOURCES, "invalid_import", "no kind of source has this name", source=str(kind))
    if kind == "column":
        require(spec.get("column") in columns, "invalid_import", "the file has no such column", column=str(spec.get("column")))
        return F.col(f"`{spec['column']}`")
    if kind == "static":
        return F.lit(spec.get("value")).cast("string")
    held = parameters if kind == "parameter" else trusted
    require(spec.get("name") in held, "invalid_import", f"{kind}: not given", name=str(spec.get("name")))
    return F.lit(held[spec["name"]]).cast("string")


def preview(
    rows: DataFrame,
    mapping: dict[str, dict[str, Any]],
    target: DataFrame,
    keys: list[str],
    *,
    on_missing: str = "insert",
    on_match: str = "update",
    parameters: dict[str, Any] | None = None,
    trusted: dict[str, Any] | None = None,
) -> DataFrame:
    """The mapped rows with ``operation`` (insert, update, skip) or ``error``.

    mapping: {field: {source, column | value | name, transforms, blank: omit | empty |
    null | error, required}}. Keys are matched with ``target``: none, one or several
    rows; several are ambiguous. The target is pre-counted by key, so a key that many
    target rows share is one row in the join."""
    require(on_missing in ("insert", "skip", "error") and on_match in ("update", "skip", "error"), "invalid_import", "policy: no such one")
    require(keys and set(keys) <= set(mapping), "invalid_import", "a key has no source")
    made, errors = [], []
    for field, spec in mapping.items():
        blank = spec.get("blank", "empty")
        require(blank in BLANKS, "invalid_import", "blank: no such policy", blank=str(blank))
        x = transformed(_source(spec, rows.columns, parameters or {}, trusted or {}), spec.get("transforms", []))
        empty = x.isNull() | (x == "")
        made.append((F.when(empty, None).otherwise(x) if blank in ("null", "omit", "error") else x).alias(field))
        if spec.get("required") or blank == "error":
            errors.append(F.when(empty, "import_required_value_missing"))
    frame = rows.select(*made, F.coalesce(*errors, F.lit(None).cast("string")).alias("_missing"))
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull() | (F.col(k) == "")
    counts = target.groupBy(*[F.col(k).cast("string").alias(f"_t_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_matches"))
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_t_{k}"))
    joined = frame.join(counts, on, "left").withColumn("_matches", F.coalesce("_matches", F.lit(0)))
    refused = {"error": "import_no_operation"}
    error = F.coalesce(
        F.col("_missing"),
        F.when(no_key, "import_key_incomplete"),
        F.when(F.col("_matches") > 1, "import_key_ambiguous"),
        F.when((F.col("_matches") == 0) & F.lit(on_missing in refused), "import_no_operation"),
        F.when((F.col("_matches") == 1) & F.lit(on_match in refused), "import_no_operation"),
    )
    operation = F.when(F.col("_matches") == 0, F.lit(on_missing)).otherwise(F.lit(on_match))
    return joined.select(*mapping, error.alias("error"), F.when(error.isNull(), operation).alias("operation"), F.col("_matches").alias("matches"))
