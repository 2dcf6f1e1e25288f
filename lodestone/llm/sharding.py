"""Sharding by a minimax contiguous partition.

Law ``bytes``: documents of equal text are atomic. Groups of equal texts are ordered by
the MD5 of the text. The smallest capacity that lets ``shards`` contiguous runs of groups
cover the order is found by binary search with a greedy check.

The driver never sees all groups: it starts from the sums of the 65,536 cells of the
hash's first 16 bits and solves the partition for them. Then it asks where a greedy check
at one byte less cuts; the cells in which these cuts fall (one a shard at most) are
replaced by their 256 parts, and so on, until all of them are single groups: then the
partition of all groups does no better, and its capacity is the minimum for groups, not
cells. The cuts are the ones nearest to equal shares that this capacity allows (the greedy
ones would leave the last shard what is left over).

Defined results: a null text counts as an empty one (size 8, CRC 0) and shares its
group; rows that repeat an id are placed each on their own; an empty table gives an
empty result. A shard may be empty if there are fewer texts than shards.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ranked


def _reach(sums: list[int], start: int, capacity: int) -> int:
    """The furthest end of a run from ``start`` that holds at most ``capacity``."""
    return bisect_right(sums, sums[start] + capacity) - 1


def feasible(sums: list[int], shards: int, capacity: int) -> bool:
    at = 0
    for _ in range(shards):
        at = _reach(sums, at, capacity)
        if at == len(sums) - 1:
            return True
    return False


def minimax_cuts(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The smallest capacity for ``shards`` contiguous runs of ``sizes``, and the ends
    of the first shards - 1 of them (indices into ``sizes``)."""
    sums = [0, *accumulate(sizes)]
    n, total = len(sizes), sums[-1]
    low, high = max([0, *sizes, -(-total // shards)]), total
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if feasible(sums, shards, middle) else (middle + 1, high)
    lowest, at = [], n  # the least that each end may be if the rest is to fit
    for _ in range(shards - 1):
        at = next_start(sums, at, low)
        lowest.append(at)
    lowest.reverse()
    cuts, at = [], 0
    for k in range(1, shards):
        ideal = bisect_right(sums, total * k / shards) - 1
        if ideal < n and sums[ideal + 1] - total * k / shards < total * k / shards - sums[ideal]:
            ideal += 1
        at = min(max(ideal, lowest[k - 1], at), _reach(sums, at, low))
        cuts.append(at)
    return low, cuts


def next_start(sums: list[int], end: int, capacity: int) -> int:
    """The least start of a run to ``end`` that holds at most ``capacity``."""
    low, high = 0, end
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if sums[end] - sums[middle] <= capacity else (middle + 1, high)
    return low


def tight_cells(sizes: list[int], shards: int, capacity: int) -> list[int]:
    """The cells that didn't fit where a greedy check at ``capacity`` cuts."""
    sums = [0, *accumulate(sizes)]
    at, found = 0, []
    for _ in range(shards if sizes else 0):
        at = _reach(sums, at, capacity)
        if at == len(sizes):
            break
        found.append(at)
    return found


def minimax_of_groups(rows: DataFrame, shards: int, digits: int = 4, more: int = 2) -> tuple[int, list[str]]:
    """The smallest capacity over the groups of ``rows`` (_key: hex digits, size), and the
    first keys of the shards but the first."""
    prefix = lambda n: F.substring("_key", 1, n)
    sums = [F.sum("size").alias("s"), (F.min("_key") == F.max("_key")).alias("single")]
    cells = {r["c"]: (r["s"], r["single"]) for r in rows.groupBy(prefix(digits).alias("c")).agg(*sums).collect()}  # 16**digits at most
    while True:
        names = sorted(cells)
        sizes = [cells[c][0] for c in names]
        capacity, cuts = minimax_cuts(sizes, shards)
        tight = [c for c in dict.fromkeys(names[i] for i in tight_cells(sizes, shards, capacity - 1)) if not cells[c][1]]
        if not tight or capacity == -(-sum(sizes) // shards):  # no capacity is less than an equal share
            return capacity, [names[i] if i < len(names) else "g" for i in cuts]  # g stands behind all digits
        part = F.coalesce(*[F.when(prefix(n).isin([c for c in tight if len(c) == n]), prefix(n + more)) for n in {len(c) for c in tight}])
        parts = rows.withColumn("c", part).where(F.col("c").isNotNull()).groupBy("c").agg(*sums).collect()  # 16**more a shard at most
        for c in tight:
            del cells[c]
        cells |= {r["c"]: (r["s"], r["single"]) for r in parts}


def shard_documents(docs: DataFrame, *, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot): each row's shard and its place there."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(
        docs.select(
            F.col(id_col).alias("_id"),
            (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.md5(text).alias("_key"),
        ),
        "shard-rows",
    )
    _, firsts = minimax_of_groups(rows, shards)
    shard = sum([(F.col("_key") >= k).cast("int") for k in firsts], F.lit(0))
    placed = materialize(rows.select("_id", "size", "text_crc32", shard.cast("int").alias("shard")), "shard-places")
    return ranked(placed, ["shard"], ["_id", "text_crc32", "size"], "slot").select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", "slot")
