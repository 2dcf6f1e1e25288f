"""Exact top-k search by inner product with a vector-approximation file.

Components become integers, floor(scale * x). The approximation file is written once: for
every vector one byte a component, the number of its cell among at most 2**bits cells of
equal width over the component's range. Then, for the queries in blocks:

1. A threshold: the k-th score among a seed, a share of the vectors drawn by a hash that
   grows with the root of their number. No later step needs a vector whose score is below.
2. The scan meets each block of queries with each block of cells only: a cell's better end
   gives an upper bound of the score, all bounds of two blocks one product of matrices.
   What reaches the threshold, and the k-th lower bound of its block, is a candidate.
3. Exact vectors are read in the order of the bounds: first the 2 k best of each query.
   Their k-th score is a new threshold; the rest is read down to it. Then no bound that is
   left reaches the k-th score: the result is certain.

So exact vectors are shuffled once a reading round, never once a block of queries; blocks
meet as bytes. Comparing all queries with all cells is the work of any exact scan.

All arithmetic is on integers; bounds are exact in the floating type that is used for
them (or widened by its error, for scores from 2**53 on). Scores must fit a long.

Defined results: vectors that are null or hold null or non-finite components take no
part; shorter vectors count as padded by zeros; an empty vector scores 0; rows that
repeat an id are candidates each, but never for a query of the same id, and
such a query is asked once, with the least of its vectors; a query with no
other vector has no rows; null ids take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

TILE = 256  # queries whose bounds stand in memory at once


def _dense(rows: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim), np.int64)
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def cell_widths(low: np.ndarray, high: np.ndarray, bits: int) -> np.ndarray:
    return (high - low) // (1 << bits) + 1


def cells_of(x: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    return ((x - low) // width).astype(np.uint8)


def kth_scores(q: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query, or the least long where there are fewer."""
    none = np.iinfo(np.int64).min
    out = np.full(len(q), none, np.int64)
    if len(x) < k:
        return out
    small = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * x.shape[1] < 1 << 53
    exact = x.T.astype(np.float64) if small else x.T
    for at in range(0, len(q), TILE):
        part = slice(at, at + TILE)
        scores = (q[part].astype(exact.dtype) @ exact).astype(np.int64)
        scores[query_ids[part, None] == ids[None, :]] = none
        out[part] = np.partition(scores, len(x) - k, axis=1)[:, len(x) - k]
    return out


def scan(
    q: np.ndarray, query_ids: np.ndarray, least: np.ndarray, cells: np.ndarray, ids: np.ndarray, low: np.ndarray, width: np.ndarray, k: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, candidates, upper bounds), by number, of what may be among the best k."""
    most = float((np.abs(q).astype(float) @ np.maximum(np.abs(low), np.abs(low + width * 256)).astype(float)).max(initial=0)) * 2
    kind = np.float32 if most < 1 << 24 else np.float64
    error = 0.0 if most < 1 << 53 else most * 2.0**-40
    columns = cells.T.astype(kind)
    for at in range(0, len(q), TILE):
        part = slice(at, at + TILE)
        ask = q[part]
        slack = np.abs(ask).astype(float) @ (width - 1).astype(float)  # upper less lower bound
        base = ask.astype(float) @ low.astype(float) + np.maximum(ask, 0).astype(float) @ (width - 1).astype(float)
        bounds = (ask * width).astype(kind) @ columns
        bounds[query_ids[part, None] == ids[None, :]] = -np.inf
        floor = least[part].astype(float) - base - error
        if len(ids) > k:  # the k-th lower bound of the block
            near = np.partition(bounds, len(ids) - k, axis=1)[:, len(ids) - k].astype(float)
            floor = np.maximum(floor, near - slack - 2 * error)
        floor = np.where(np.isfinite(floor), floor, -np.inf)
        query, found = np.nonzero((bounds >= floor[:, None]) & (bounds > -np.inf))
        yield query + at, found, bounds[query, found].astype(float) + base[query] + error


def usable(vector: Column) -> Column:
    """Not null, and no component null or not finite."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, lambda x: F.coalesce(odd(x), F.lit(True))), F.lit(False))


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def _ranges(rows: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest value of each component; one row a batch leaves Python."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _dense(batch["_v"], dim)
            if len(x):
                yield pd.DataFrame({"at": np.arange(dim), "low": x.min(axis=0), "high": x.max(axis=0)})

    found = rows.select("_v").mapInPandas(each, "at int, low long, high long").groupBy("at").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    low, high = np.zeros(dim, np.int64), np.zeros(dim, np.int64)
    for r in found.collect():  # ``dim`` rows
        low[r["at"]], high[r["at"]] = r["low"], r["high"]
    return low, high


def _scores(pairs: DataFrame, rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, _id, score) of (query_id, _key): exact vectors are read here only."""
    joined = pairs.join(rows.select("_key", "_id", F.col("_v").alias("_x")), "_key").join(asked.select(F.col("_id").alias("query_id"), F.col("_v").alias("_y")), "query_id")
    products = F.zip_with("_x", "_y", lambda a, b: F.coalesce(a * b, F.lit(0)))
    return joined.select("query_id", "_id", F.aggregate(products, F.lit(0).cast("long"), lambda s, x: s + x).alias("score"))


def top_k(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    is_query: Column | None = None,
    k: int = 20,
    scale: int = 64,
    bits: int = 6,
    block: int = 16_384,
    query_block: int = 16_384,
) -> DataFrame:
    """(query_id, rank, id, score) for every row that ``is_query`` holds for."""
    if not 1 <= bits <= 8:
        raise ValueError("a cell's number is one byte")
    doubles = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("_id"),
        doubles.alias("_v"),
        F.coalesce(F.lit(True) if is_query is None else is_query, F.lit(False)).alias("_q"),
    )
    rows = rows.where(usable(F.col("_v"))).select(
        F.monotonically_increasing_id().alias("_key"), "_id", "_q", F.transform("_v", lambda x: F.floor(F.lit(float(scale)) * x).cast("long")).alias("_v")
    )
    rows = materialize(rows, "vectors")  # the keys stay as written
    count = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("_q").alias("q"), F.max(F.size("_v")).alias("d")).first()
    blocks, query_blocks, dim = -(-count["n"] // block) or 1, -(-count["q"] // query_block) or 1, count["d"] or 0
    low, high = _ranges(rows, dim)
    width = cell_widths(low, high, bits)
    seeds = max(-(-count["n"] // max(block, 4 * isqrt(k * count["n"]))), 1)

    def to_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["_key", "_id"]].assign(_cells=[c.tobytes() for c in cells_of(_dense(batch["_v"], dim), low, width)])

    cells = materialize(rows.select("_key", "_id", "_v").mapInPandas(to_cells, "_key long, _id long, _cells binary"), "vector-cells")
    # a query that repeats is asked once
    asked = rows.where("_q").groupBy("_id").agg(F.min("_v").alias("_v"))
    asked = asked.withColumn("_qb", F.pmod(F.xxhash64("_id", F.lit("query")), F.lit(query_blocks)))
    asked = materialize(asked, "vector-queries")
    seed = rows.where(F.pmod(F.xxhash64("_key", F.lit("seed")), F.lit(seeds)) == 0).select(F.explode(_numbers(query_blocks)).alias("_qb"), "_id", "_v")

    def thresholds(ask: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        ids = ask["_id"].to_numpy()
        least = kth_scores(_dense(ask["_v"], dim), ids, _dense(some["_v"], dim), some["_id"].to_numpy(), k)
        return ask[["_id", "_v", "_qb"]].assign(_least=least)

    known = asked.groupBy("_qb").cogroup(seed.groupBy("_qb")).applyInPandas(thresholds, "_id long, _v array<long>, _qb long, _least long")
    known = materialize(known, "vector-thresholds")
    in_block = F.pmod(F.xxhash64("_key", F.lit("block")), F.lit(blocks))
    dealt = cells.select(in_block.alias("_b"), F.explode(_numbers(query_blocks)).alias("_qb"), "_key", "_id", "_cells")
    met = known.select(F.explode(_numbers(blocks)).alias("_b"), "_qb", "_id", "_v", "_least")

    def bounds(ask: pd.DataFrame, file: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(ask) and len(file):
            matrix = np.frombuffer(b"".join(file["_cells"]), np.uint8).reshape(len(file), dim)
            query_ids, keys = ask["_id"].to_numpy(), file["_key"].to_numpy()
            for query, found, bound in scan(_dense(ask["_v"], dim), query_ids, ask["_least"].to_numpy(), matrix, file["_id"].to_numpy(), low, width, k):
                out.append(pd.DataFrame({"query_id": query_ids[query], "_key": keys[found], "_bound": bound}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.empty(0, np.int64), "_key": np.empty(0, np.int64), "_bound": np.empty(0)})

    found = met.groupBy("_b", "_qb").cogroup(dealt.groupBy("_b", "_qb")).applyInPandas(bounds, "query_id long, _key long, _bound double")
    in_order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_bound"), "_key"))
    candidates = materialize(found.withColumn("_place", in_order), "vector-candidates")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "_id")
    first = materialize(_scores(candidates.where(F.col("_place") <= 2 * k), rows, asked), "vector-scores")
    certain = first.withColumn("_n", F.row_number().over(best)).where(F.col("_n") == k).select("query_id", F.col("score").alias("_kth"))
    rest = candidates.where(F.col("_place") > 2 * k).join(certain, "query_id").where(F.col("_bound") >= F.col("_kth"))
    every = first.unionAll(_scores(rest.select("query_id", "_key"), rows, asked))
    return (
        every.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("_id").alias(id_col), "score")
    )
