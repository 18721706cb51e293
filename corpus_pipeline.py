"""From raw documents to packed sequences: the stages, and all of them in a row.

Each stage works on all rows that its predecessor kept.  Decisions come back to the rows by a hash of id and text (or of
what was judged), not by id alone, so that neither null nor repeated ids mix up documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import drop_table, materialise, scratch_scope, small_side
from quillframe.llm.exact_dedup import drop_exact_duplicates
from quillframe.llm.mixing import mix
from quillframe.llm.near_dedup import drop_near_duplicates
from quillframe.llm.packing import best_fit_pack
from quillframe.llm.quality import judge


def _key(*columns: str) -> Column:
    """128 bits that tell rows apart by these columns, null from any value."""
    parts = [c for name in columns for c in (F.col(name).isNull().cast("string"), F.coalesce(F.col(name).cast("string"), F.lit("")))]
    return F.md5(F.concat_ws("\x1f", *parts).cast("binary"))


def _unused(docs: DataFrame) -> str:
    """A name that no column has."""
    return "_k" * (1 + max(map(len, docs.columns), default=0))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or lie outside their language's perplexity band go."""
    key = _unused(docs)
    told = judge(docs.select(_key("lang", "text").alias(key), "lang", "text"), id_col=key)
    gone = materialise(told.where("not kept").select(key).distinct(), "rejected")
    return docs.withColumn(key, _key("lang", "text")).join(small_side(gone, gone.count(), 48), key, "left_anti").select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates (five words, 0.8) stays."""
    return drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it.

    Rows equal in all columns are interchangeable: one of them stands as often as the mix takes all of them together."""
    key, names = _unused(docs), docs.columns
    n, repeated = f"{key}_n", f"{key}_r"
    mixed = mix(docs.select(_key(*names).alias(key), "source", "text"), id_col=key)
    taken = mixed.groupBy(key).agg(F.sum("copies").cast("int").alias(n), (F.count(F.lit(1)) > 1).alias(repeated))
    taken = materialise(taken.where(F.col(n) > 0), "mix-copies")
    rows = docs.withColumn(key, _key(*names)).join(small_side(taken, taken.count(), 64), key)
    rows = rows.where(~F.col(repeated)).unionByName(rows.where(repeated).dropDuplicates([key]))
    return rows.withColumn(repeated, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*names)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return best_fit_pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can express neither the language model nor the draws; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's scratch tables go once its rows are written, and those rows once the next stage's are."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with scratch_scope(spark):
            docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"), outside=True)
        written.append(docs.inputFiles())
        if len(written) > 1:
            drop_table(spark, written[-2])
    packed = STAGES[-1][1](spark, docs, sf_dir)  # reads tables of its own only
    drop_table(spark, written[-1])
    return packed
