"""Line dedup: lines that many documents share stay in one document only.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z
lower-cased. Keys of ``min_chars`` code points or more that ``min_docs`` distinct
documents hold lose all their lines, except in the largest id that holds them.

Steps: explode the long lines of each document as (position, hash of the key); count
distinct documents a hash (partial aggregates, so a hot line costs one row a task); write
the hashes over the threshold and join them back to the positions, by broadcast up to
BROADCAST_ROWS of them (counted), else by a shuffle join whose hot keys AQE can split;
gather each row's positions to drop, and put its text together from the lines at the
others, in order. This is linear in lines and drops. Texts are shuffled once at
most, keys never. A hash is an MD5, as a string: array functions and joins hash strings,
but compare binaries one by one.

Defined results: a null or empty text is one empty line and stays as it is; a row
whose id is null is no document: its lines are not counted and stay; rows that repeat
an id count as one document; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SPACES, ascii_lower, let, materialize


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _row(id_col: str, text_col: str) -> list[Column]:
    """What tells rows apart by which lines they hold: rows that repeat an id may
    have other texts. Equal rows lose equal lines."""
    return [F.col(id_col).alias("_ld_id"), F.xxhash64(F.col(text_col)).alias("_ld_text")]


def lines_to_drop(docs: DataFrame, id_col: str, text_col: str, min_docs: int, min_chars: int) -> DataFrame:
    """(_ld_id, _ld_text, _ld_drop): for each row that loses lines, their positions in
    ascending order, from 1."""
    long_lines = F.filter(
        F.transform(_lines(F.col(text_col)), lambda x, i: F.struct((i + 1).alias("at"), _key(x).alias("key"))), lambda x: F.length(x["key"]) >= min_chars
    )
    hashed = F.transform(long_lines, lambda x: F.struct(x["at"].alias("at"), F.md5(x["key"]).alias("h")))
    held = docs.where(F.col(id_col).isNotNull() & (F.length(text_col) >= min_chars)).select(*_row(id_col, text_col), hashed.alias("_all"))
    # a row's hash is made before its lines are dealt out, not once a line
    held = held.select("_ld_id", "_ld_text", F.explode("_all").alias("_x"))
    places = materialize(held.select("_ld_id", "_ld_text", F.col("_x.at").alias("_at"), F.col("_x.h").alias("_h")), "line-places")
    shared = (
        places.groupBy("_h")
        .agg(F.count_distinct("_ld_id").alias("_n"), F.max("_ld_id").alias("_last"))
        .where(F.col("_n") >= min_docs)
        .select("_h", "_last")
    )
    shared = materialize(shared, "shared-lines")
    if shared.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        shared = F.broadcast(shared)
    dropped = places.join(shared, "_h").where(F.col("_ld_id") != F.col("_last"))
    return dropped.groupBy("_ld_id", "_ld_text").agg(F.sort_array(F.collect_set("_at")).alias("_ld_drop"))


def _without(lines: Column, drop: Column) -> Column:
    """``lines`` without the positions ``drop``, by a mask of the positions that stay:
    slices would each copy the whole array, a search would look through all drops."""
    gaps = F.zip_with(F.concat(F.array(F.lit(0)), drop), drop, lambda a, b: b - a - 1)
    runs = F.transform(F.filter(gaps, lambda g: g.isNotNull()), lambda g: F.concat(F.array_repeat(F.lit(True), g), F.array(F.lit(False))))
    return let(F.flatten(runs), lambda mask: F.filter(lines, lambda x, i: F.coalesce(F.get(mask, i), F.lit(True))))


def dedup_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, min_chars: int = 20
) -> DataFrame:
    """``docs`` with shared lines dropped from ``text_col``, plus ``line_count`` and
    ``lines_dropped`` (long); columns of these names in ``docs`` are replaced."""
    drops = lines_to_drop(docs, id_col, text_col, min_docs, min_chars)
    kept = docs.drop("line_count", "lines_dropped")
    given, text = _row(id_col, text_col)
    joined = kept.withColumn("_ld_row", F.struct(given, text)).join(
        drops.select(F.struct("_ld_id", "_ld_text").alias("_ld_row"), "_ld_drop"), "_ld_row", "left"
    )
    with_stays = joined.withColumn("_ld_n", F.size(_lines(F.col(text_col))).cast("long")).withColumn(
        "_ld_stays", F.when(F.col("_ld_drop").isNotNull(), let(_lines(F.col(text_col)), lambda x: F.array_join(_without(x, F.col("_ld_drop")), "\n")))
    )
    return with_stays.select(
        *[F.coalesce("_ld_stays", text_col).alias(c) if c == text_col else F.col(f"`{c}`") for c in kept.columns],
        F.col("_ld_n").alias("line_count"),
        F.when(F.col("_ld_drop").isNotNull(), F.size("_ld_drop")).otherwise(0).cast("long").alias("lines_dropped"),
    )
