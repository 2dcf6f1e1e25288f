"""Chat formatting: collapse cumulative snapshots, then render.

A log often holds a conversation again and again as it grows. Turns are ordered by
turn number (ties by role, then text) and every turn gets a 128-bit hash of (place,
role, text); the running XOR of these is the hash of each turn prefix. A conversation
whose whole hash is a proper prefix of a longer one goes by an anti-join, of equal ones
the smallest id stays; the rest are maximal and rendered.

Only hashes are shuffled for the comparison; prefixes are made distinct before the
join, so a first turn that a third of all conversations share is one row.

Defined results: a null role or text differs from the empty string when compared and
renders as empty; a row without a conversation id belongs to none and is a conversation
of one turn, so these rows are never gathered; rows that repeat a turn are turns of their
own; an empty table gives an empty result. A conversation is one row of the result, and
its turns meet in one task at the end; before that, its turns are a sorted stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import keyed, materialize

#: ChatML, as published: role and text between these marks.
TEMPLATE = ("<|im_start|>", "\n", "<|im_end|>\n")


def _hashed(turns: DataFrame) -> DataFrame:
    """(_c, _k, _a, _b): halves of a 128-bit hash of a turn at place _k."""
    mark = F.md5(F.concat_ws("|", F.col("_k").cast("string"), F.length("_r").cast("string"), "_r", "_x"))
    half = lambda a: F.conv(F.substring(mark, a, 15), 16, 10).cast("long")
    return turns.select("_c", "_k", half(1).alias("_a"), half(16).alias("_b"))


def maximal_conversations(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(_c, _n, _a, _b, _copies): the conversations that stay, by id or, where all have
    none, by their hash; their turns, and how many equal conversations each stands for."""
    order = Window.partitionBy("_c").orderBy(F.col("_t").asc_nulls_first(), F.col("_r"), F.col("_x"))
    given = turns.select(
        F.col(conv_col).alias("_c"),
        F.col(turn_col).alias("_t"),
        F.md5(keyed(F.col(role_col))).alias("_r"),
        F.md5(keyed(F.col(text_col))).alias("_x"),
    )
    hashed = _hashed(given.where(F.col("_c").isNotNull()).withColumn("_k", F.row_number().over(order)))
    lone = _hashed(given.where(F.col("_c").isNull()).withColumn("_k", F.lit(1)))
    running = Window.partitionBy("_c").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    prefixes = hashed.select(
        "_c",
        "_k",
        F.expr("bit_xor(_a)").over(running).alias("_a"),
        F.expr("bit_xor(_b)").over(running).alias("_b"),
        (F.lead("_k").over(Window.partitionBy("_c").orderBy("_k")).isNull()).alias("_last"),
    )
    prefixes = materialize(prefixes.unionByName(lone.withColumn("_last", F.lit(True))), "chat-prefixes")
    whole = (
        prefixes.where("_last")
        .groupBy("_k", "_a", "_b")
        # min() skips null: a null id stands only if no other conversation is equal
        .agg(F.min("_c").alias("_c"), F.count(F.lit(1)).alias("_copies"))
    )
    proper = prefixes.where("NOT _last").select("_k", "_a", "_b").distinct()
    return whole.join(proper, ["_k", "_a", "_b"], "left_anti").select("_c", F.col("_k").alias("_n"), "_a", "_b", "_copies")


def format_chats(
    turns: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    template: tuple[str, str, str] = TEMPLATE,
) -> DataFrame:
    """(conversation id, n_turns, n_copies, text) of every maximal conversation."""
    stay = materialize(maximal_conversations(turns, conv_col, turn_col, role_col, text_col), "chat-maximal")
    start, middle, end = template
    cells = turns.select(F.col(conv_col).alias("_c"), F.col(turn_col).alias("_t"), F.col(role_col).alias("_r"), F.col(text_col).alias("_x"))
    order = F.struct(
        F.col("_t").isNotNull().alias("p"),
        F.col("_t").alias("t"),
        F.md5(keyed(F.col("_r"))).alias("a"),
        F.md5(keyed(F.col("_x"))).alias("b"),
        F.coalesce("_r", F.lit("")).alias("r"),
        F.coalesce("_x", F.lit("")).alias("x"),
    )
    shown = lambda r, x: F.concat(F.lit(start), r, F.lit(middle), x, F.lit(end))
    named = cells.join(stay.where(F.col("_c").isNotNull()).select("_c", "_n", "_copies"), "_c")
    named = named.groupBy("_c").agg(
        F.max("_n").cast("long").alias("n_turns"),
        F.max("_copies").alias("n_copies"),
        F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda x: shown(x["r"], x["x"])), "").alias("text"),
    )
    # of equal rows without an id one is shown, by their hash
    lone = cells.where(F.col("_c").isNull()).select("_r", "_x").distinct()
    marked = _hashed(lone.select(F.struct("_r", "_x").alias("_c"), F.lit(1).alias("_k"), F.md5(keyed(F.col("_r"))).alias("_r"), F.md5(keyed(F.col("_x"))).alias("_x")))
    text = shown(F.coalesce("_c._r", F.lit("")), F.coalesce("_c._x", F.lit("")))
    nameless = stay.where(F.col("_c").isNull()).select("_a", "_b", F.col("_copies").alias("n_copies")).join(marked.select("_a", "_b", text.alias("text")), ["_a", "_b"])
    nameless = nameless.select(F.lit(None).cast(cells.schema["_c"].dataType).alias("_c"), F.lit(1).cast("long").alias("n_turns"), "n_copies", "text")
    return named.unionByName(nameless).withColumnRenamed("_c", conv_col)
