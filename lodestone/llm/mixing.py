"""Mixing sources to target weights by Pareto order sampling.

Targets: the words of the mix are shared out by weight; a source's target stops at
``max_repeats`` times its words and the excess goes to the others by weight (water
filling, solved exactly by cumulative sums over the sources in the order in which they
fill up).

A document's expected copies are the source's target / words, tilted by size like
samples with probability proportional to size: e = rho + tilt * min(rho, R - rho) *
(t - mean t), with t = size / (size + mean size) and the mean weighted by size. So the
expected words are the target exactly and e stays within 0 and R = ``max_repeats``.
The whole copies floor(e) are certain. For the fraction p = e - floor(e), documents are
ranked by random odds divided by inclusion odds, (u / (1 - u)) / (p / (1 - p)), and the
first of the ranking are taken, up to the size that is left to the target (the one on
the border if more than half of it fits): a sample of fixed size in words.

u comes from an MD5 of seed and id, so reruns agree on any cluster. Ranks are summed up
in two levels, (source, 4096 ranges of the rank), so that a hot source is not in one
task; the ranges are cut where u of a document of the source's mean inclusion would be,
so they hold alike many rows however small the inclusion is. Sums are of integers. Sources
are ordered and summed up in ranges too, so there may be any number of them.

Defined results: a null text has size 0 and is never worth taking (0 words); a null
source is a source of its own and comes last; rows that repeat an id are sampled each
(equal rows share a rank and stand side by side); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import attach, keyed, materialize, n_words, running

RANGES = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """(_s, source_size, _docs, weight, target) from rows (_s, _source, size)."""
    per = materialize(sizes.groupBy("_s", "_source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs")), "mix-sources")
    by_name = [F.col("_source").isNull(), F.col("_source")]
    per = running(per, by_name, {"_place": F.lit(1)})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_place") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    per = per.withColumn("weight", weight).withColumn("_cap", (F.col("source_size") * max_repeats).cast("double")).withColumn("_fill", F.col("_cap") / F.col("weight"))
    per = materialize(running(materialize(per, "mix-sources"), [F.col("_fill"), *by_name], {"_caps": F.col("_cap"), "_weights": F.col("weight")}), "mix-fills")
    total, all_weights = per.agg(F.sum("source_size").cast("double"), F.sum("weight")).first()
    # the level of water if this source and those after it share what those before leave
    level = (F.lit(total) - (F.col("_caps") - F.col("_cap"))) / (F.lit(all_weights) - (F.col("_weights") - F.col("weight")))
    # the first source that the level doesn't fill fixes the level of all after it
    final = per.withColumn("_level", level).agg(F.min(F.when(F.col("_level") <= F.col("_fill"), F.struct("_fill", "_level")))).first()[0]
    target = F.col("_cap")
    if final is not None:
        target = F.when(F.col("_fill") < final["_fill"], F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("weight") * F.lit(final["_level"])))
    return per.select("_s", "source_size", "_docs", "weight", target.alias("target"))


def uniform(seed: int, key: Column) -> Column:
    """Uniform in (0, 1) with 52 bits, from an MD5."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), keyed(key))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[int, ...] = (5, 2, 1),
    max_repeats: int = 3,
    tilt: float = 0.5,
    seed: int = 20,
    keep: dict[str, Column] | None = None,
) -> DataFrame:
    """(id, size, source_size, target, copies, taken) per row. ``keep``: further
    columns by name."""
    more = keep or {}
    sizes = materialize(
        docs.select(
            F.col(id_col).alias("_id"),
            F.col(source_col).alias("_source"),
            keyed(F.col(source_col)).alias("_s"),
            n_words(F.col(text_col)).alias("size"),
            *[v.alias(f"_keep_{k}") for k, v in more.items()],
        ),
        "mix-sizes",
    )
    targets = materialize(source_targets(sizes, weights, max_repeats), "mix-targets")
    rows = attach(sizes, targets, ["_s"])
    mean = F.floor(F.col("source_size") / F.greatest(F.col("_docs"), F.lit(1)))
    t = F.floor(F.lit(1024) * F.col("size") / F.greatest(F.col("size") + mean, F.lit(1)))
    rows = rows.withColumn("_t", t)
    means = materialize(rows.groupBy("_s").agg((F.sum(F.col("_t") * F.col("size")) / F.greatest(F.sum("size"), F.lit(1))).alias("_tm")), "mix-means")
    rows = attach(rows, means, ["_s"])
    rho = F.col("target") / F.greatest(F.col("source_size"), F.lit(1))
    e = rho + tilt * F.least(rho, max_repeats - rho) * (F.col("_t") - F.col("_tm")) / 1024
    rows = rows.withColumn("_e", F.greatest(F.least(e, F.lit(float(max_repeats))), F.lit(0.0)))
    rows = rows.withColumn("_whole", F.floor("_e")).withColumn("_p", F.col("_e") - F.col("_whole")).withColumn("_u", uniform(seed, F.col("_id")))
    rank = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))
    rows = rows.withColumn("_q", F.when((F.col("_p") > 0) & (F.col("size") > 0), rank))
    names = [f"_keep_{k}" for k in more]
    rows = materialize(rows.select("_id", "_s", "size", "source_size", "target", "_whole", "_p", "_q", *names), "mix-draws")
    per = rows.groupBy("_s").agg(F.sum(F.col("_whole") * F.col("size")).alias("_certain"), F.avg(F.when(F.col("_q").isNotNull(), F.col("_p"))).alias("_mean_p"))
    per = materialize(per, "mix-certain")
    # q times the odds of a usual document is u's odds for it: ranges that hold like many rows
    odds = F.col("_mean_p") / (1 - F.col("_mean_p"))
    spread = F.floor(F.col("_q") * odds / (1 + F.col("_q") * odds) * RANGES)
    aside = F.pmod(F.xxhash64("_id", "size"), F.lit(RANGES)) - RANGES  # of rows that aren't drawn
    rows = attach(rows, per, ["_s"]).withColumn("_range", F.when(F.col("_q").isNull(), aside).otherwise(F.least(spread, F.lit(RANGES - 1))).cast("int"))
    rows = materialize(rows.drop("_p", "_mean_p"), "mix-rows")
    parts = rows.where(F.col("_q").isNotNull()).groupBy("_s", "_range").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("_s").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_s", "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_s", "_range").orderBy("_q", "_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(starts, ["_s", "_range"], "left").withColumn("_up", F.col("_start") + F.sum("size").over(inside))
    left = F.col("target") - F.col("_certain")
    drawn = F.col("_q").isNotNull() & (2 * F.col("_up") - F.col("size") <= 2 * left)
    copies = (F.col("_whole") + F.when(drawn, 1).otherwise(0)).cast("long")
    return placed.select(
        F.col("_id").alias(id_col),
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"),
        *[F.col(n).alias(k) for n, k in zip(names, more)],
    )
