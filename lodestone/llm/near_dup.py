"""Near-duplicate detection by min-max hashing.

A text's set is that of its distinct 5-word shingles (ASCII lower case), as 64-bit
hashes. Each of ``permutations`` hash functions gives two values of the signature, the
minimum and the maximum, so half the evaluations give a signature of the same length.
``bands`` bands of ``rows`` values make bucket keys; pairs that share a bucket are
candidates, and a link is confirmed on the full sets. At the defaults (80 permutations,
32 bands of 5 values) a pair at similarity 0.85 is missed with probability 7e-9.

No bucket emits all its pairs:

1. Texts of equal sets are one class, represented by its smallest id; only
   representatives go on. A group of copies is one row a task after partial sums.
2. In a fixed quarter of the buckets, every member is paired with one hub (the member
   with the least hash of id and bucket, another one in every bucket). Confirmed links
   are joined into components.
3. Of all buckets, only those that still hold several components can yield a further
   link. In buckets of at most ``small`` members, members of different components are
   paired by an equi-join and confirmed. Larger buckets are families of many variants,
   most of them below the threshold to each other; their members are gathered into
   families (components of bucket sharing), dealt into classes of like set sizes, and each
   class into blocks of ``block`` members and ``BLOCK_VALUES`` shingles at most. Linked
   sets stand in one class or in neighbouring ones; every such pair of blocks is one
   group, in which the full sets are intersected as matrix products. What it emits are
   confirmed links only, one a member and component.
4. Components of all confirmed links.

Sizes prune before any comparison: similar sets have similar sizes.

Defined results: a null or empty text, or one without words, has the empty set and no
links; of rows that repeat an id, the least text counts and all get its result; rows
without an id have no component and stay; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .graph import components

MASK = (1 << 64) - 1
#: Bytes of ids that are broadcast rather than shuffling all texts to meet them; an id
#: counts as its text and 16 bytes.
BROADCAST_BYTES = 48_000_000
#: Shingles (8 bytes each) of a block of a family.
BLOCK_VALUES = 2_000_000


def mixed(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants (splitmix64)."""
    out, x = [], seed
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & MASK
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK
        out.append((z ^ (z >> 31)) | 1)
    return np.array(out, np.uint64)


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _WordHashes(dict):
    """Hashes of words seen by this worker; emptied when there are 120,000."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 120_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_words = _WordHashes()


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; of the whole if shorter."""
    # bytes.lower() changes A-Z only, bytes.split() splits at [\x20\x09-\x0D] only
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    hashes = np.array([_words[w] for w in parts], np.uint64)
    k = min(width, len(parts))
    factors = mixed(width, 7)
    out = np.full(len(parts) - k + 1, k, np.uint64)
    for i in range(k):
        out += hashes[i : len(parts) - k + 1 + i] * factors[i]
    return np.unique(_finish(out))


class MinMax:
    """Signatures of ``permutations`` minima and as many maxima."""

    def __init__(self, permutations: int = 80, bands: int = 32, rows: int = 5):
        if bands * rows != 2 * permutations:
            raise ValueError("bands * rows must be twice the permutations")
        self.factors, self.shifts = mixed(permutations, 11)[:, None], mixed(permutations, 13)[:, None]
        self.bands, self.rows = bands, rows
        self.band_factors, self.band_ids = mixed(rows, 17), mixed(bands, 19)

    def signature(self, values: np.ndarray) -> np.ndarray:
        low, high = None, None
        for at in range(0, len(values), 4096):
            hashed = values[None, at : at + 4096] * self.factors + self.shifts
            a, b = hashed.min(axis=1), hashed.max(axis=1)
            low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
        return np.stack([low, high], axis=1).ravel()

    def buckets(self, signature: np.ndarray) -> np.ndarray:
        rows = signature.reshape(self.bands, self.rows)
        return _finish((rows * self.band_factors).sum(axis=1, dtype=np.uint64) + self.band_ids).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _sets(docs: DataFrame, id_type: str, permutations: int, bands: int, rows: int, width: int) -> DataFrame:
    """(_id, _key, _n, _buckets) of docs (_id, _text)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        family = MinMax(permutations, bands, rows)
        for batch in batches:
            out = []
            for text in batch["_text"]:
                s = shingles(text, width)
                if len(s):
                    sig = family.signature(s)
                    out.append((hashlib.blake2b(s.tobytes(), digest_size=16).digest(), len(s), family.buckets(sig)))
                else:
                    out.append((None, 0, None))
            more = pd.DataFrame(out, columns=["_key", "_n", "_buckets"])
            yield pd.concat([batch[["_id"]].reset_index(drop=True), more], axis=1)

    return docs.mapInPandas(each, f"_id {id_type}, _key binary, _n long, _buckets array<long>")


def _full_sets(ids: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(_id, _set) of the texts with these ids; texts: (_id, _text), one row an id."""
    id_type = texts.schema["_id"].dataType.simpleString()

    def to_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["_id"]].assign(_set=[shingles(t, width).tobytes() for t in batch["_text"]])

    needed = materialize(ids.distinct(), "ids")
    size = needed.agg(F.sum(F.octet_length(F.col("_id").cast("string")) + 16)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        needed = F.broadcast(needed)  # else the texts are shuffled
    wanted = texts.join(needed, "_id", "left_semi")
    return materialize(wanted.mapInPandas(to_sets, f"_id {id_type}, _set binary"), "sets")


def _confirm(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs (a, b) whose texts' full sets are similar enough."""
    sets = _full_sets(pairs.select(F.col("a").alias("_id")).unionAll(pairs.select(F.col("b").alias("_id"))), texts, width)
    id_type = texts.schema["_id"].dataType.simpleString()

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch["_x"], batch["_y"])]
            yield batch.loc[kept, ["a", "b"]]

    joined = pairs.join(sets.select(F.col("_id").alias("a"), F.col("_set").alias("_x")), "a")
    joined = joined.join(sets.select(F.col("_id").alias("b"), F.col("_set").alias("_y")), "b")
    return materialize(joined.select("a", "b", "_x", "_y").mapInPandas(check, f"a {id_type}, b {id_type}"), "links")


def _near_sizes(x: str, y: str, percent: int) -> Column:
    return F.lit(100) * F.least(x, y) >= F.lit(percent) * F.greatest(x, y)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 85,
    width: int = 5,
    permutations: int = 80,
    bands: int = 32,
    rows: int = 5,
    small: int = 16,
    block: int = 512,
    keep: dict[str, Column] | None = None,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row. ``keep``: further columns by name."""
    more = keep or {}
    id_type = docs.schema[id_col].dataType.simpleString()
    named = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[v.alias(f"_keep_{k}") for k, v in more.items()])
    given = named.where(F.col("_id").isNotNull()).select("_id", "_text")
    repeated = not given.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    if repeated:
        given = given.groupBy("_id").agg(F.min("_text").alias("_text"))
    sets = materialize(_sets(given.select("_id", "_text"), id_type, permutations, bands, rows, width), "shingle-sets")
    classes = materialize(sets.where("_n > 0").groupBy("_key").agg(F.min("_id").alias("_rep")), "classes")
    found = sets.select("_id", "_key", "_n", "_buckets").join(classes, [sets["_key"] == classes["_key"], sets["_id"] == classes["_rep"]], "left_semi")
    dealt = found.select(F.col("_id").alias("_rep"), "_n", F.explode("_buckets").alias("_h"))
    hubs = (
        dealt.groupBy("_h")
        .agg(F.count(F.lit(1)).alias("_m"), F.min(F.struct(F.xxhash64("_rep", "_h").alias("o"), F.col("_rep").alias("id"), F.col("_n").alias("n"))).alias("_hub"))
        .where("_m > 1")
    )
    hubs = materialize(hubs, "hubs")  # both sides of the join are then shuffles that AQE can split
    members = materialize(dealt.join(hubs, "_h").select("_h", "_m", "_rep", "_n", F.col("_hub.id").alias("_hub"), F.col("_hub.n").alias("_hub_n")), "members")

    first = members.where((F.pmod("_h", F.lit(4)) == 0) & (F.col("_rep") != F.col("_hub")) & _near_sizes("_n", "_hub_n", percent))
    tried = materialize(_ordered(first.select(F.col("_rep").alias("a"), F.col("_hub").alias("b"))), "pairs")
    links = _confirm(tried, given, percent, width)
    labels = components(links)

    labelled = members.join(labels, members["_rep"] == labels["node"], "left").select("_h", "_m", "_rep", "_n", "_hub", F.coalesce("label", "_rep").alias("_l"))
    labelled = materialize(labelled, "labelled")
    mixed_buckets = labelled.groupBy("_h").agg(F.min("_l").alias("_l0"), F.max("_l").alias("_l1")).where("_l0 != _l1").select("_h")
    mixed_buckets = materialize(mixed_buckets, "mixed-buckets")
    open_ = materialize(labelled.join(mixed_buckets, "_h", "left_semi"), "open")
    families = materialize(_families(open_.where(F.col("_m") > small), labelled), "families")
    kin = families.select(F.col("_rep").alias("_kin"), "_g")
    few = open_.where(F.col("_m") <= small).join(kin, F.col("_rep") == F.col("_kin"), "left").drop("_kin")
    x, y = (few.select("_h", *[F.col(c).alias(f"{c}{k}") for c in ("_rep", "_n", "_l", "_g")]) for k in (1, 2))
    across = (F.col("_rep1") < F.col("_rep2")) & (F.col("_l1") != F.col("_l2")) & _near_sizes("_n1", "_n2", percent)
    # two members of one family are compared there
    across = across & F.coalesce(F.col("_g1") != F.col("_g2"), F.lit(True))
    pairs = _ordered(x.join(y, "_h").where(across).select(F.col("_rep1").alias("a"), F.col("_rep2").alias("b")))
    rest = materialize(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
    links = links.unionAll(_confirm(rest, given, percent, width))
    links = links.unionAll(_family_links(families, given, percent, width, block))

    labels = components(links)
    whole = classes.join(labels, classes["_rep"] == labels["node"], "left").select("_key", F.coalesce("label", "_rep").alias("_l"))
    placed = sets.select("_id", "_key", "_n").join(whole, "_key", "left").select("_id", "_key", "_n", F.coalesce("_l", "_id").alias("_l"))
    if more or repeated:
        out = named.drop("_text").join(placed.select("_id", "_n", "_l"), "_id", "left")
    else:
        lost = named.where(F.col("_id").isNull()).select("_id", F.lit(0).cast("long").alias("_n"), F.lit(None).cast(id_type).alias("_l"))
        out = placed.select("_id", "_n", "_l").unionAll(lost)
    return out.select(
        F.col("_id").alias(id_col),
        F.coalesce("_n", F.lit(0)).alias("n_shingles"),
        F.col("_l").alias("component_id"),
        F.coalesce(F.col("_id") == F.col("_l"), F.lit(True)).alias("kept"),
        *[F.col(f"_keep_{k}").alias(k) for k in more],
    )


def _families(open_: DataFrame, labelled: DataFrame) -> DataFrame:
    """(_g, _rep, _l, _n): members of large open buckets by family, with their component
    and set size."""
    family = components(open_.select(F.col("_rep").alias("a"), F.col("_hub").alias("b"))).select(F.col("node").alias("_rep"), F.col("label").alias("_g"))
    # a member has one component, on each of its rows
    own = labelled.groupBy("_rep").agg(F.min("_l").alias("_l"), F.min("_n").alias("_n"))
    return family.join(own, "_rep")


def linked(first: list[np.ndarray], second: list[np.ndarray], percent: int) -> np.ndarray:
    """The matrix of ``similar`` between two lists of sorted distinct arrays: counts of
    shared values, as products of 0/1 matrices of 4096 values at a time."""
    sizes = [np.array([len(x) for x in side], np.int64) for side in (first, second)]
    a, b = np.concatenate(first), np.concatenate(second)
    shared = np.intersect1d(np.unique(a), np.unique(b), assume_unique=True)
    rows = [np.repeat(np.arange(len(side)), n) for side, n in zip((first, second), sizes)]
    common = np.zeros((len(first), len(second)), np.float32)
    places = [np.searchsorted(shared, x) for x in (a, b)]
    for at in range(0, len(shared), 4096):
        part = []
        for values, place, row, n in zip((a, b), places, rows, (len(first), len(second))):
            here = (place >= at) & (place < min(at + 4096, len(shared)))
            here &= shared[np.minimum(place, len(shared) - 1)] == values
            dense = np.zeros((n, min(4096, len(shared) - at)), np.float32)
            dense[row[here], place[here] - at] = 1
            part.append(dense)
        common += part[0] @ part[1].T
    both = common.astype(np.int64)
    return 100 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both)


def _family_links(families: DataFrame, texts: DataFrame, percent: int, width: int, block: int) -> DataFrame:
    """Links (a, b) between components of a family: for every member, one to each other
    component that it is linked to."""
    id_type = texts.schema["_id"].dataType.simpleString()
    # a hair more than the greatest ratio of linked sizes: these are at most one class apart
    step = log(100 / percent) * (1 + 1e-9) if percent < 100 else 1e-9
    sized = families.withColumn("_c", F.floor(F.log("_n") / step))
    fit = F.least(F.greatest(F.floor(F.lit(BLOCK_VALUES) / F.max("_n")), F.lit(1)), F.lit(block))
    classes = sized.groupBy("_g", "_c").agg(F.ceil(F.count(F.lit(1)) / fit).cast("int").alias("_blocks"))
    classes = materialize(classes, "family-classes")
    beside = lambda d, name: classes.select("_g", (F.col("_c") + d).alias("_c"), F.col("_blocks").alias(name))
    classes = classes.join(beside(1, "_below"), ["_g", "_c"], "left").join(beside(-1, "_above"), ["_g", "_c"], "left")
    cut = sized.join(classes, ["_g", "_c"]).withColumn("_block", F.pmod(F.xxhash64("_rep"), F.col("_blocks")).cast("int"))
    sets = _full_sets(families.select(F.col("_rep").alias("_id")), texts, width)
    others = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda c1, i, c2, j: F.struct(c1.alias("c1"), i.alias("i"), c2.alias("c2"), j.alias("j"))
    c, own = F.col("_c"), F.col("_block")
    met = F.concat(
        F.transform(others(F.col("_blocks")), lambda j: pair(c, F.least(own, j), c, F.greatest(own, j))),
        F.transform(others(F.col("_below")), lambda j: pair(c - 1, j, c, own)),
        F.transform(others(F.col("_above")), lambda j: pair(c, own, c + 1, j)),
    )
    dealt = (
        cut.withColumn("_pair", F.explode(met))
        .join(sets, F.col("_rep") == sets["_id"])
        .select("_g", "_pair.c1", "_pair.i", "_pair.c2", "_pair.j", "_c", "_block", "_rep", "_l", "_set")
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        c1, i, c2, j = (group[k].iloc[0] for k in ("c1", "i", "c2", "j"))
        first = group[(group["_c"] == c1) & (group["_block"] == i)]
        second = group[(group["_c"] == c2) & (group["_block"] == j)]
        a, b = [], []
        if len(first) and len(second) and group["_l"].nunique() > 1:
            hit = linked(*[[np.frombuffer(v, np.uint64) for v in side["_set"]] for side in (first, second)], percent)
            labels, ids = second["_l"].to_numpy(), second["_rep"].to_numpy()
            hit &= first["_l"].to_numpy()[:, None] != labels[None, :]
            for k in np.flatnonzero(hit.any(axis=1)):
                at = np.flatnonzero(hit[k])
                _, one = np.unique(labels[at], return_index=True)
                b += ids[at[one]].tolist()
                a += [first["_rep"].iloc[k]] * len(one)
        return pd.DataFrame({"a": a, "b": b})

    return materialize(dealt.groupBy("_g", "c1", "i", "c2", "j").applyInPandas(compare, f"a {id_type}, b {id_type}"), "links")
