"""Helpers shared by the training-data operators: shared scratch tables, ranks
that split hot groups, joins with small tables whose size is checked."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The white space that the contracts name: ``[\x20\x09-\x0D]``.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A table is broadcast only after its rows were counted and are no more than this.
BROADCAST_ROWS = 50_000

_written: list[tuple[SparkSession, str]] = []
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A session without
    ``spark.checkpoint.dir`` gets a temporary one, in local mode only."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="lodestone-"))
    return _own_dir[0]


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for folder in _own_dir:  # a session's own folder is local
        shutil.rmtree(folder.removeprefix("file://"), ignore_errors=True)
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again. This cuts
    the lineage: a lost executor costs no recomputation of what stands before.
    The files go when the process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a materialized table that no later plan reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        for known in [x for x in _written if path.rstrip("/").endswith(x[1].rsplit("/", 1)[1])]:
            _remove(*known)
            _written.remove(known)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text, none for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({WORD})"), 1), F.array().cast("array<string>"))


def n_words(text: Column) -> Column:
    """Number of words without building them: word starts are non-spaces after a space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes the fast path."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def keyed(value: Column) -> Column:
    """A grouping key that keeps null apart from every string."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("-"))


def attach(df: DataFrame, small: DataFrame, keys: Sequence[str], salts: int = 32, rows: int | None = None) -> DataFrame:
    """Left join with a table of a few rows a key. It is broadcast if it has at most
    BROADCAST_ROWS rows (counted first, unless the caller counted that it has no more than
    ``rows``); beyond that the keys are salted, so that a hot key is met by ``salts``
    tasks. Keys must not be null."""
    if (small.limit(BROADCAST_ROWS + 1).count() if rows is None else rows) <= BROADCAST_ROWS:
        return df.join(F.broadcast(small), list(keys), "left")
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if not isinstance(df.schema[c].dataType.jsonValue(), dict)]), F.lit(salts)).cast("int"))
    return dealt.join(spread, [*keys, "_salt"], "left").drop("_salt")


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str, per_task: int = 200_000) -> DataFrame:
    """Number the rows of each group from 0, gapless, without one task per group: rows
    are dealt into parts by a hash of ``order``, counted, and numbered inside their part
    on from the parts before. There are as many parts as ``per_task`` goes into all rows, 32
    at least, so a part holds no more than about that many, however large its group. ``df`` is read three times:
    materialize it first. Rows that tie on all of ``order`` may swap numbers; make them
    equal rows."""
    salts = max(32, -(-df.count() // per_task))
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = dealt.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, "_part").orderBy(*order)
    return (
        dealt.join(starts, [*group, "_part"])
        .withColumn(out, F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_part", "_start")
    )


def running(df: DataFrame, order: Sequence[Column], sums: dict[str, Column], per_task: int = 200_000) -> DataFrame:
    """``df`` with running sums over one order of all rows, without one task for them:
    rows are dealt into ranges of the order, summed, and summed up inside their range on
    from the ranges before. ``df`` is read twice: materialize it first."""
    parts = max(1, -(-df.count() // per_task))
    dealt = materialize(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "running")
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = dealt.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over ``parts`` rows
    starts = totals.select("_part", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_t_{k}") for k in sums])
    placed = dealt.join(F.broadcast(starts), "_part")
    return placed.select(*df.columns, *[(F.sum(c).over(inside) + F.col(f"_t_{k}")).alias(k) for k, c in sums.items()])
