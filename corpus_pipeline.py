"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir), docs with the columns of documents, and works
on all that its predecessor kept; all but the last return these columns. Rows that
repeat, null ids, texts, languages and sources, and empty tables go through every stage;
what each does with them stands in its operator's docstring. Columns beyond those of
documents are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm import common, line_dedup, mixing, near_dup, packing, quality
from lodestone.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bin packing and min-max hashing are not for SQL; tests hold run() against brute force.
ORACLE_SQL = None


def _key() -> Column:
    """With doc_id it tells rows apart whose ids repeat."""
    return F.xxhash64(F.col("text"))


def _same(a: DataFrame, b: DataFrame, columns: tuple[str, ...]) -> Column:
    match = F.lit(True)
    for c in columns:
        match = match & a[c].eqNullSafe(b[c])
    return match


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    verdict = quality.judge(docs, keep={"_key": _key()})
    kept = verdict.where("kept").select("doc_id", "_key").distinct()
    rows = docs.select(*COLUMNS).withColumn("_key", _key())
    return rows.join(kept, _same(rows, kept, ("doc_id", "_key")), "left_semi").select(*COLUMNS)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shared lines go; n_chars becomes that of the text that is left."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group (similarity of 0.8 or more) stays: the one of the
    smallest id. Of rows that repeat an id one stays; rows without an id all stay."""
    rows = docs.select(*COLUMNS)
    lost = rows.where(F.col("doc_id").isNull())  # never joined or gathered: null would be one hot key
    found = rows.where(F.col("doc_id").isNotNull())
    kept = near_dup.near_duplicates(found, percent=80).where("kept").select("doc_id").distinct()
    stay = found.join(kept, "doc_id", "left_semi")
    ids = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if not ids.where("n > 1").isEmpty():
        place = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", "source", "lang"))
        stay = stay.withColumn("_n", place).where(F.col("_n") == 1)
    return stay.select(*COLUMNS).unionAll(lost)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    drawn = mixing.mix(docs, keep={"_key": _key(), "source": F.col("source")})
    names = ("doc_id", "_key", "source")
    copies = common.materialize(drawn.groupBy(*names).agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows")), "copies")
    rows = docs.select(*COLUMNS).withColumn("_key", _key())
    joined = rows.join(copies.select(*[F.col(c).alias(f"_c_{c}") for c in names], "_copies"), _match(names))
    if not copies.where("_rows > 1").isEmpty():  # equal rows: the first brings the copies of all
        joined = joined.withColumn("_n", F.row_number().over(Window.partitionBy(*names).orderBy("lang")))
        joined = joined.withColumn("_copies", F.when(F.col("_n") == 1, F.col("_copies")).otherwise(0))
    return joined.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))).select(*COLUMNS)


def _match(names: tuple[str, ...]) -> Column:
    match = F.lit(True)
    for c in names:
        match = match & F.col(c).eqNullSafe(F.col(f"_c_{c}"))
    return match


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path=tokenizer_path())


STAGES = [
    ("quality", quality_rules),
    ("line_dedup", drop_shared_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.materialize(docs, f"pipeline-{name}")
    return docs
