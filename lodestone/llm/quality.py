"""Quality rules: counting rules, then robust multivariate outliers.

Every text gives a vector of transformed statistics: log of the mean word length, square
root of the share of capitals among the characters of words, symbols a word, share of
repeated lines, share of repeated words. Each is smoothed as if ``PSEUDO`` words (or 10
lines) of the language's average stood before the text, so that short texts don't spread
more than long ones. Per language and source, the minimum covariance determinant (MCD)
of these vectors is sought as FAST-MCD does (Rousseeuw and Van Driessen, 1999):

1. Starts: coordinate-wise median and interquartile range; mean and covariance of all;
   ``random_starts`` elemental sets of P + 2 vectors, drawn by a hash.
2. A concentration step ranks the vectors by Mahalanobis distance and estimates mean and
   covariance on the ``support`` share that lies nearest; it never raises the
   determinant. After two steps the two starts of least determinant go on, until the
   determinant stops falling; the least one is kept.
3. The distances are scaled so that their ``support`` quantile is that of chi-square
   (consistency and small samples at once), mean and covariance are estimated anew on all
   vectors within the 0.975 quantile of chi-square, and scaled again.

A document is rejected if its squared distance exceeds the 1 - ``tail`` quantile of
chi-square with P degrees. The estimate breaks down at 1 - ``support`` of junk in a group.

A direction in which the support doesn't vary (no symbols at all, say) makes the covariance
singular. Only there, where a pivot of the Cholesky factor falls below ``FLOORS``, the
floor takes its place: the least deviation that counts as one.

All of it is DataFrame code. A concentration step is one aggregation for all groups and
starts: moments per (group, start, bucket of log distance) with map-side partial sums,
then cumulative sums over at most 240 buckets; the bucket on the border counts by the
share of it that the support needs. So a group that holds a third of all rows is never in
one task, and nothing is collected but row counts. Equal vectors count once, so copies
of one text can't pass for the norm.

Groups of fewer than ``min_rows`` documents that pass the base rules are pooled per
language; where that is not enough, they are judged by an estimate over all documents of
their language, and then by one over all documents; only in a table of fewer than
``min_rows`` such documents the base rules decide alone.

Defined results: a null text has no words and fails the base rule; null language or
source are groups of their own; rows that repeat are judged each; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACES, attach, keyed, let, materialize, words

FEATURES = ("x0", "x1", "x2", "x3", "x4")
P = len(FEATURES)
#: Least standard deviations, for directions in which the support doesn't vary.
FLOORS = (0.002, 0.002, 0.02, 0.05, 0.08)
#: Words of the language's average that smooth each statistic.
PSEUDO = 100
#: Names the group of all documents; before a language's key, that of all its documents.
WHOLE = "*"
LOW, HIGH, PER_UNIT = -10, 20, 8  # buckets of the natural log of the squared distance
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def chi2_quantile(share: float, degrees: int) -> float:
    """Quantile of chi-square, by bisection of the series of its distribution."""

    def below(x: float) -> float:
        term = total = 2 / degrees
        k = degrees / 2
        while term > total * 1e-16:
            k += 1
            term *= x / 2 / k
            total += term
        return total * math.exp(-x / 2 + degrees / 2 * math.log(x / 2) - math.lgamma(degrees / 2))

    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < share else (low, middle)
    return high


def _repeated_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more. A distinct count of
    64-bit hashes clears most texts; the others compare the windows themselves."""
    n = F.size(w)
    at = lambda a, i: F.get(a, i)
    starts = F.sequence(F.lit(0), n - 3)
    hashes = F.transform(starts, lambda i: F.xxhash64(at(w, i), at(w, i + 1), at(w, i + 2)))
    grams = F.sort_array(
        F.transform(starts, lambda i: F.struct(F.concat_ws(" ", at(w, i), at(w, i + 1), at(w, i + 2)).alias("g"), i.alias("p")))
    )

    def places(s: Column) -> Column:
        same = lambda i, j: F.coalesce(at(s, i)["g"] == at(s, j)["g"], F.lit(False))
        found = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
        return F.sort_array(F.transform(found, lambda i: at(s, i)["p"]))

    def covered(p: Column) -> Column:
        steps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda s, x: s + x)

    some = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(n < 4, 0).when(some, let(let(grams, places), covered)).otherwise(0).cast("long")


def text_statistics(docs: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    """``keep`` and the counts of each text, over all of it."""
    text = F.col("_text")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    found = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    return (
        docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
        .withColumn(
            "_w",
            let(
                words(text),
                lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("c"), _repeated_words(w).alias("r")),
            ),
        )
        .withColumn("_l", let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))))
        .select(
            *[c for c in docs.select(*keep).columns],
            F.col("_w.n").alias("n_words"),
            F.col("_w.c").alias("word_chars"),
            found("[#*$%&|<>]").alias("n_symbols"),
            F.col("_l.d").alias("n_dup_lines"),
            F.col("_w.r").alias("n_repeat_words"),
            F.col("_l.n").alias("n_lines"),
            found("[A-Z]").alias("n_capitals"),
        )
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def _vector() -> list[Column]:
    """The features, from the counts and the language's word length and capitals."""
    words_, chars = F.col("n_words") + PSEUDO, F.col("word_chars") + PSEUDO * F.col("_word_length")
    return [
        F.log(chars / words_),
        F.sqrt((F.col("n_capitals") + PSEUDO * F.col("_word_length") * F.col("_capitals")) / chars),
        F.col("n_symbols") / words_,
        F.col("n_dup_lines") / (F.col("n_lines") + 10),
        F.col("n_repeat_words") / words_,
    ]


def _with_distance(vectors: DataFrame, model: DataFrame, rows: int | None = None) -> DataFrame:
    """``vectors`` with the model of their group (a row for each of its starts) and
    ``_d``, the squared distance in regular directions, and ``_e``, in singular ones;
    null where the group has no model. y is built column by column, so that no
    expression is repeated inside another. ``rows``: the most that ``model`` has, where
    it is known."""
    y = [f"(x{i} - m{i}" + "".join(f" - l{i}{j} * _y{j}" for j in range(i)) + f") / l{i}{i} AS _y{i}" for i in range(P)]
    total = lambda test: " + ".join(f"IF({test}r{i}, _y{i} * _y{i}, 0D)" for i in range(P))
    both = [f"IF(m0 IS NOT NULL, {total(test)}, NULL) AS {name}" for test, name in (("", "_d"), ("NOT ", "_e"))]
    return attach(vectors, model, ["_g"], rows=rows).selectExpr("*", *y, *both).drop(*[f"_y{i}" for i in range(P)], *[f"l{i}{j}" for i, j in PAIRS])


def _factored(cov: DataFrame) -> DataFrame:
    """Columns c{i}{j} (j <= i) become the Cholesky factor l{i}{j}, whether direction i
    is regular, r{i}, and the log of the determinant's root, ld."""
    steps = []
    for i, j in PAIRS:
        rest = f"(c{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j)) + ")"
        if i == j:
            steps += [f"{rest} > {FLOORS[i] ** 2}D AS r{i}", f"IF(r{i}, SQRT(GREATEST({rest}, 0D)), {FLOORS[i]}D) AS l{i}{i}"]
        else:
            steps.append(f"{rest} / l{j}{j} AS l{i}{j}")
    root = " + ".join(f"LN(l{i}{i})" for i in range(P)) + " AS ld"
    return cov.selectExpr("*", *steps, root).drop(*[f"c{i}{j}" for i, j in PAIRS])


def _moments(centred: bool = True) -> list[Column]:
    """Sums of rows, features and their products, about m{i} if ``centred``."""
    z = [f"(x{i} - m{i})" if centred else f"x{i}" for i in range(P)]
    return [F.expr(x) for x in ("COUNT(1) AS n", *[f"SUM({z[i]}) AS s{i}" for i in range(P)], *[f"SUM({z[i]} * {z[j]}) AS s{i}{j}" for i, j in PAIRS])]


def _estimate(sums: DataFrame, keys: list[str], centred: bool = True) -> DataFrame:
    """The model (means and factored covariance) of ``_moments``."""
    means = [f"{f'm{i} + ' if centred else ''}s{i} / n AS m{i}" for i in range(P)]
    return _factored(sums.selectExpr(*keys, *means, *[f"s{i}{j} / n - s{i} * s{j} / n / n AS c{i}{j}" for i, j in PAIRS]))


def _bucket(d2: Column) -> Column:
    return F.least(F.greatest(F.floor(F.log(d2 + 1e-9) * PER_UNIT), F.lit(LOW * PER_UNIT)), F.lit(HIGH * PER_UNIT - 1)).cast("int")


def _median_start(vectors: DataFrame) -> DataFrame:
    """Medians and interquartile ranges from histograms of 1/512 a bin."""
    bins = (
        vectors.select("_g", F.posexplode(F.array(*[F.floor(F.least(F.col(c), F.lit(30.0)) * 512).cast("int") for c in FEATURES])).alias("f", "b"))
        .groupBy("_g", "f", "b")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    w = Window.partitionBy("_g", "f")
    at = bins.withColumn("up", F.sum("n").over(w.orderBy("b"))).withColumn("all", F.sum("n").over(w))
    q = lambda share: F.min(F.when(F.col("up") >= F.col("all") * share, (F.col("b") + 0.5) / 512))
    cells = at.groupBy("_g", "f").agg(q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"))
    pick = lambda f, c: F.max(F.when(F.col("f") == f, c))
    spread = F.pow((F.col("q3") - F.col("q1")) / 1.349, 2)
    return _factored(
        cells.groupBy("_g").agg(
            *[pick(i, F.col("q2")).alias(f"m{i}") for i in range(P)],
            *[(pick(i, spread) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS],
        )
    )


def _starts(vectors: DataFrame, random_starts: int) -> DataFrame:
    """The models that concentration starts from, numbered by _s."""
    first = _median_start(vectors).withColumn("_s", F.lit(0))
    whole = _estimate(vectors.groupBy("_g").agg(*_moments(centred=False)), ["_g"], centred=False).withColumn("_s", F.lit(1))
    slots = P + 2
    drawn = vectors.withColumn("_s", F.explode(F.array(*[F.lit(2 + k) for k in range(random_starts)]))).withColumn("_o", F.xxhash64("_s", *FEATURES))
    drawn = drawn.groupBy("_g", "_s", F.pmod("_o", F.lit(slots)).alias("_slot")).agg(*[F.min_by(c, "_o").alias(c) for c in FEATURES])
    few = _estimate(drawn.groupBy("_g", "_s").agg(*_moments(centred=False)), ["_g", "_s"], centred=False)
    out = first.unionByName(whole)
    return out.unionByName(few) if random_starts else out


def _concentrate(vectors: DataFrame, model: DataFrame, support: float, rows: int) -> DataFrame:
    """The models estimated on the ``support`` share nearest to each model of a group,
    with ``fell``: by how much the determinant's log did."""
    df = _with_distance(vectors, model, rows).where(F.col("_d").isNotNull()).withColumn("b", _bucket(F.col("_d") + F.col("_e")))
    own = [f"m{i}" for i in range(P)]
    cells = df.groupBy("_g", "_s", "b").agg(*_moments(), F.first("ld").alias("_before"), *[F.first(c).alias(c) for c in own])
    w = Window.partitionBy("_g", "_s")
    below = F.coalesce(F.sum("n").over(w.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    need = F.col("_all") * support - F.col("_below")
    near = cells.withColumn("_below", below).withColumn("_all", F.sum("n").over(w)).where(need > 0).withColumn("_part", F.least(need / F.col("n"), F.lit(1.0)))
    sums = ["n", *[f"s{i}" for i in range(P)], *[f"s{i}{j}" for i, j in PAIRS]]
    whole = near.groupBy("_g", "_s").agg(*[F.sum(F.col(c) * F.col("_part")).alias(c) for c in sums], F.first("_before").alias("_before"), *[F.first(c).alias(c) for c in own])
    new = _estimate(whole, ["_g", "_s", "_before"])
    return materialize(new.withColumn("fell", F.col("_before") - F.col("ld")).drop("_before"), "mcd-model")


def _least(models: DataFrame, n: int) -> DataFrame:
    """The ``n`` models of least determinant of each group."""
    place = F.row_number().over(Window.partitionBy("_g").orderBy("ld", "_s"))
    return models.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def _scaled(vectors: DataFrame, model: DataFrame, support: float, rows: int) -> DataFrame:
    """``model`` with _scale: what _d is divided by, so that its ``support`` quantile is
    that of chi-square with as many degrees as there are regular directions."""
    cells = _with_distance(vectors, model, rows).where(F.col("_d").isNotNull()).groupBy("_g", _bucket(F.col("_d")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("_g")
    at = cells.withColumn("up", F.sum("n").over(w.orderBy("b"))).withColumn("all", F.sum("n").over(w))
    over = F.col("up") - F.col("all") * support
    at = at.where((over >= 0) & (over < F.col("n")))  # the bucket that holds the quantile
    border = at.select("_g", F.exp((F.col("b") + 1 - over / F.col("n")) / PER_UNIT).alias("_border"))
    degrees = reduce(lambda a, b: a + b, [F.col(f"r{i}").cast("int") for i in range(P)])
    quantiles = F.array(F.lit(1.0), *[F.lit(chi2_quantile(support, k)) for k in range(1, P + 1)])
    out = model.drop("_scale").join(border, "_g").withColumn("_scale", F.greatest(F.col("_border") / F.get(quantiles, degrees), F.lit(1e-9)))
    return materialize(out.drop("_border"), "mcd-scaled")


def robust_model(vectors: DataFrame, *, support: float = 0.75, random_starts: int = 4) -> DataFrame:
    """(_g, m, l, r, _scale): the reweighted MCD estimate of each group of vectors
    (_g, x0, ...)."""
    model = materialize(_starts(vectors, random_starts), "mcd-model")
    rows = model.count()  # no later model has more
    for _ in range(2):
        model = _concentrate(vectors, model, support, rows)
    model = materialize(_least(model, 2), "mcd-model")
    done = model.limit(0)
    while True:
        moving = model.where("fell > 1e-5")
        done = done.unionByName(model.where("NOT fell > 1e-5"))
        if moving.isEmpty():
            break
        model = _concentrate(vectors, moving, support, rows)
    # the union has a table a step: it is read once, here, and not by all that follows
    model = materialize(_least(done, 1).drop("_s", "fell"), "mcd-model")
    model = _scaled(vectors, model, support, rows)
    near = _with_distance(vectors, model, rows).where(F.col("_d") / F.col("_scale") + F.col("_e") <= chi2_quantile(0.975, P))
    sums = near.groupBy("_g").agg(*_moments(), *[F.first(f"m{i}").alias(f"m{i}") for i in range(P)])
    model = materialize(_estimate(sums, ["_g"]), "mcd-model")
    return _scaled(vectors, model, support, rows).drop("ld")


def judge(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    support: float = 0.75,
    random_starts: int = 4,
    min_rows: int = 50,
    tail: float = 0.001,
    keep: dict[str, Column] | None = None,
) -> DataFrame:
    """(id, the counts, base_failed, d2, kept) per row; d2 is null where no estimate
    applies, or no row of its language and source passes the base rules. ``tail``: share
    of normal vectors that the cutoff rejects. ``keep``: further columns by name."""
    more = keep or {}
    lang = F.to_json(F.struct(keyed(F.col(lang_col)).alias("l")))
    both = F.to_json(F.struct(keyed(F.col(lang_col)).alias("l"), keyed(F.col(source_col)).alias("s")))
    stats = text_statistics(docs, text_col, [F.col(id_col).alias("_id"), both.alias("_ls"), lang.alias("_l0"), *[v.alias(f"_keep_{k}") for k, v in more.items()]])
    rows = materialize(stats.withColumn("base_failed", base_failed()), "quality-rows")
    counted = [F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_{c}") for c in ("n_words", "word_chars", "n_capitals")]]
    sizes = materialize(rows.where(~F.col("base_failed")).groupBy("_ls", "_l0").agg(*counted), "quality-sizes")
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    of_lang = Window.partitionBy("_l0")
    sum_of = lambda c: F.sum(c).over(of_lang)
    groups = (
        sizes.withColumn("_pool", F.sum(F.when(F.col("_n") < min_rows, F.col("_n"))).over(of_lang))
        .withColumn("_lang", sum_of("_n"))
        .withColumn("_word_length", sum_of("_word_chars") / sum_of("_n_words"))
        .withColumn("_capitals", sum_of("_n_capitals") / sum_of("_word_chars"))
        .withColumn(
            "_g",
            F.when(F.col("_n") >= min_rows, F.col("_ls"))
            .when(F.col("_pool") >= min_rows, F.col("_l0"))
            .when(F.col("_lang") >= min_rows, F.concat(F.lit(WHOLE), "_l0"))
            .when(F.lit(total >= min_rows), F.lit(WHOLE)),
        )
        .withColumn("_whole", F.max(F.when(F.col("_g") == F.concat(F.lit(WHOLE), "_l0"), F.col("_g"))).over(of_lang))
    )
    groups = materialize(groups.select("_ls", "_g", "_whole", "_word_length", "_capitals"), "quality-groups")
    # the estimates that a row takes part in: its group's, and the wider ones that any group needs
    wide = F.lit(None if groups.where(F.col("_g") == WHOLE).isEmpty() else WHOLE).cast("string")
    estimates = F.array_distinct(F.array_compact(F.array("_g", "_whole", wide)))
    judged = materialize(attach(rows, groups, ["_ls"]).withColumns(dict(zip(FEATURES, _vector()))), "quality-features")
    vectors = judged.where(~F.col("base_failed")).select(F.explode(estimates).alias("_g"), *FEATURES).distinct()
    model = robust_model(materialize(vectors, "quality-vectors"), support=support, random_starts=random_starts)
    judged = _with_distance(judged.withColumn("_g", F.coalesce("_g", F.lit(""))), model)
    judged = judged.withColumn("d2", F.col("_d") / F.col("_scale") + F.col("_e"))
    return judged.select(
        F.col("_id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "d2",
        (~F.col("base_failed") & ~F.coalesce(F.col("d2") > chi2_quantile(1 - tail, P), F.lit(False))).alias("kept"),
        *[F.col(f"_keep_{k}").alias(k) for k in more],
    )
