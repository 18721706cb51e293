"""Ranks and windows (WIN): fusion, adaptive selection, chunks, budgets, collision suffixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, by: list[str], order: list[Column], name: str = "rank", depth: int | None = None) -> DataFrame:
    """Ranks from 1 within a group.  With a depth Spark keeps only the best of each task before the shuffle."""
    out = rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    return out if depth is None else out.where(F.col(name) <= depth)


def fuse(first: DataFrame, second: DataFrame, by: list[str], key: str, k: int = 60, limit: int = 10) -> DataFrame:
    """Reciprocal rank fusion of two rankings (by, key, rank): sum of 1 / (k + rank); one side may be empty.

    Equal sums go to the better rank in the first, then in the second ranking, then to the smaller key."""
    both = first.select(*by, key, F.col("rank").alias("rank_1")).join(second.select(*by, key, F.col("rank").alias("rank_2")), [*by, key], "full_outer")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    both = both.withColumn("rrf", F.round(part("rank_1") + part("rank_2"), 9))
    return ranked(both, by, [F.desc("rrf"), F.col("rank_1").asc_nulls_last(), F.col("rank_2").asc_nulls_last(), F.col(key)], "rank", limit)


def adaptive_select(hits: DataFrame, by: list[str], score: str, tie: str, floor: float = 0.65, gap: float = 0.12, min_keep: int = 4, max_keep: int = 8) -> DataFrame:
    """``reason`` for each hit: below the floor goes; the first ``min_keep`` stay, those from ``max_keep`` go, between
    them those within ``gap`` of the best stay."""
    w = Window.partitionBy(*by)
    r = F.row_number().over(w.orderBy(F.desc(score), tie)) - 1
    top = F.max(score).over(w)
    out = hits.withColumn("_r", r).withColumn("_top", top)
    reason = F.when(F.col(score) < floor, "floor").when(F.col("_r") < min_keep, "kept").when(F.col("_r") >= max_keep, "cap").when(F.col(score) >= F.round(F.col("_top") - gap, 9), "kept").otherwise("gap")
    return out.withColumn("reason", reason).drop("_r", "_top")


def words(text: Column) -> Column:
    """A text's words, parted by ASCII white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def windows(held: Column, size: int, overlap: int) -> Column:
    """Slices of ``size`` words every ``size - overlap``, up to the one that reaches the end."""
    step = size - overlap
    last = F.greatest(F.ceil((F.size(held) - size) / F.lit(step)), F.lit(0)).cast("int")
    return F.transform(F.transform(F.sequence(F.lit(0), last), lambda i: i * step), lambda at: F.slice(held, at + 1, size))


def chunks(rows: DataFrame, key: str, text: str, size: int = 250, overlap: int = 60, least: int = 30) -> DataFrame:
    """Windows of ``size`` words every ``size - overlap``, up to the one that reaches the end; a last one below ``least``
    words goes, unless it is the only one."""
    w = rows.select(key, words(F.col(text)).alias("_w"))
    # Only the windows leave the row, not the whole text beside each of them.
    every = w.where(F.size("_w") > 0).select(key, F.posexplode(windows(F.col("_w"), size, overlap)).alias("chunk_id", "_c"))
    return every.where((F.size("_c") >= least) | (F.col("chunk_id") == 0)).select(key, "chunk_id", F.array_join("_c", " ").alias("chunk"), F.size("_c").alias("n_words"))


def chunk_texts(held: Column, size: int = 250, overlap: int = 60, least: int = 30) -> Column:
    """The same chunks as an array, from a text's words; ``held`` should be a plain column, as it is read for each window."""
    some = F.filter(windows(held, size, overlap), lambda c, i: (F.size(c) > 0) & ((F.size(c) >= least) | (i == 0)))
    return F.transform(some, lambda c: F.array_join(c, " "))


def allocate(rows: DataFrame, by: list[str], order: str, size: str, budget: int, most: int) -> DataFrame:
    """A running budget in the given order: each row gets its size up to ``most`` and what is left; rows that get nothing go."""
    want = F.least(F.col(size), F.lit(most))
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(budget) - F.coalesce(F.sum(want).over(before), F.lit(0))
    return rows.withColumn("_left", left).where("_left > 0").select(*by, order, F.greatest(F.lit(0), F.least(want, F.col("_left"))).cast("long").alias("granted"))


def collision_suffix(rows: DataFrame, name: str, order: str) -> DataFrame:
    """'' for the first row of a name, then b, c, ... z, then its number."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return rows.withColumn("suffix", F.when(k == 1, "").when(k <= 26, F.char((F.lit(96) + k).cast("int"))).otherwise(k.cast("string")))


def unreferenced(hits: DataFrame, links: DataFrame, by: str, key: str) -> DataFrame:
    """Hits that the page doesn't link to yet."""
    return hits.join(links, [by, key], "left_anti")
