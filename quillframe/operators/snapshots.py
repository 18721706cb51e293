"""Snapshots (SNK, SET): upserts, reconciliation, drift and ledgers as joins between an old and a new table.

A snapshot is written to a new folder and swapped in; a path that is being read is never overwritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """All rows of ``new`` and those of ``old`` whose key it doesn't have."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def reconcile(old: DataFrame, fresh: DataFrame, key: list[str], text: str, graded: list[str]) -> DataFrame:
    """``fresh`` rows with the ``graded`` columns of ``old`` where the text is unchanged, else null; vanished keys go."""
    before = old.select(*key, F.col(text).alias("_text"), *[F.col(c).alias(f"_{c}") for c in graded])
    same = F.col(text).eqNullSafe(F.col("_text"))
    return fresh.join(before, key, "left").select(*fresh.columns, *[F.when(same, F.col(f"_{c}")).alias(c) for c in graded])


def drift(disk: DataFrame, db: DataFrame, key: str, changed: str, indexed: str) -> DataFrame:
    """key, kind for keys that are missing in the index, extra there, or stale (changed after they were indexed)."""
    both = disk.select(key, F.col(changed).alias("_changed"), F.lit(True).alias("_on_disk")).join(db.select(key, F.col(indexed).alias("_indexed"), F.lit(True).alias("_in_db")), key, "full_outer")
    kind = F.when(F.col("_in_db").isNull(), "missing").when(F.col("_on_disk").isNull(), "extra").when(F.col("_changed") > F.col("_indexed"), "stale")
    return both.select(key, kind.alias("kind")).where("kind is not null")


def backlog(current: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Keys without a ledger row, or with another fingerprint there."""
    seen = ledger.select(key, F.col("fingerprint").alias("_seen"))
    return current.join(seen, key, "left").where(~F.col("fingerprint").eqNullSafe(F.col("_seen"))).select(key, F.when(F.col("_seen").isNull(), "new").otherwise("changed").alias("why"))


def edge_upsert(old: DataFrame, new: DataFrame, key: list[str], skip_rejected: bool = True) -> DataFrame:
    """Inserts, updates status and confidence, and leaves rejected edges alone; ``action`` tells which."""
    o = old.select(*key, F.col("status").alias("_status"), F.col("confidence").alias("_confidence"), F.lit(True).alias("_old"))
    n = new.select(*key, "status", "confidence", F.lit(True).alias("_new"))
    both = o.join(n, key, "full_outer")
    action = F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "inserted").when(F.lit(skip_rejected) & (F.col("_status") == "rejected"), "skipped").otherwise("updated")
    take = F.col("action").isin("inserted", "updated")
    return both.withColumn("action", action).select(*key, F.when(take, F.col("status")).otherwise(F.col("_status")).alias("status"), F.when(take, F.col("confidence")).otherwise(F.col("_confidence")).alias("confidence"), "action")


def last_write_wins(events: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return events.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def ranking_diff(a: DataFrame, b: DataFrame, key: str, score: str) -> DataFrame:
    """improved, regressed or unchanged from ``a`` to ``b``; a missing score is below all others."""
    both = a.select(key, F.col(score).alias("_a")).join(b.select(key, F.col(score).alias("_b")), key, "full_outer")
    low = F.lit(float("-inf"))
    x, y = F.coalesce("_a", low), F.coalesce("_b", low)
    return both.select(key, F.when(y > x, "improved").when(y < x, "regressed").otherwise("unchanged").alias("change"))


def swap_in(df: DataFrame, folder: str, version: str) -> str:
    """Writes a new version beside the others and returns its path; readers take the greatest version."""
    path = f"{folder.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def latest(spark: SparkSession, folder: str) -> DataFrame:
    every = spark.read.parquet(folder)
    top = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == F.lit(top)).drop("version")


def cache_refresh(rows: DataFrame, cache: DataFrame, key: list[str], text_hash: str) -> tuple[DataFrame, DataFrame]:
    """(cached rows that still hold, rows to compute anew): by key and content hash."""
    on = [*key, text_hash]
    return rows.join(cache, on, "inner"), rows.join(cache.select(*on), on, "left_anti")
