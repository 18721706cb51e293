"""Aggregations (AGG) beyond plain sums: upper medians, reciprocal concentration, replicate statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upper_median(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The element n // 2 of the sorted values (from 0), which is the upper of two middle ones.

    Equal values are counted before they are ranked, so a group is never gathered in one array; the window
    runs over a group's distinct values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    up, all_of = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by)
    ranked = counts.withColumn("_upto", F.sum("_n").over(up)).withColumn("_of", F.sum("_n").over(all_of))
    return ranked.where(F.col("_upto") > F.floor(F.col("_of") / 2)).groupBy(*by).agg(F.min(value).alias("upper_median"))


def fingerprint(rows: DataFrame, by: str, text: Column) -> DataFrame:
    """sha256 over a group's sorted texts: equal for equal sets in any order."""
    return rows.groupBy(by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(text)), "\x1e"), 256).alias("fingerprint"))


def weighted_recall(rows: DataFrame, axis: str, score: Column, weight: Column) -> DataFrame:
    """sum(score * weight) / sum(weight) per axis and overall (axis null) in one pass."""
    return rows.rollup(axis).agg(F.count(F.lit(1)).alias("n"), (F.sum(score * weight) / F.sum(weight)).alias("recall"))


def replicate_stats(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, sample deviation (0 below two values), least and greatest."""
    return rows.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.nanvl(F.stddev_samp(value), F.lit(0.0)), F.lit(0.0)).alias("sd"),
        F.min(value).alias("lo"), F.max(value).alias("hi"))


def paired_t(delta: Column) -> list[Column]:
    """n, mean, t = mean / sqrt(var / n) and df; fewer than two pairs give t = 0 and df = 0, no variance gives 0 or infinity."""
    n, mean, var = F.count(delta), F.avg(delta), F.var_samp(delta)
    t = F.when(n < 2, 0.0).when(var == 0, F.when(mean == 0, 0.0).otherwise(F.signum(mean) * F.lit(float("inf")))).otherwise(mean / F.sqrt(var / n))
    return [n.alias("n"), mean.alias("mean_delta"), t.alias("t"), F.greatest(n - 1, F.lit(0)).alias("df")]


def mode_first_seen(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """Each group's most frequent value; of several the one seen first by ``order``."""
    counted = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("votes"), F.min(order).alias("first_seen"))
    best = Window.partitionBy(*by).orderBy(F.desc("votes"), "first_seen")
    return counted.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def reciprocal_top1(nearest: DataFrame, sizes: DataFrame, least_size: int, share: float) -> DataFrame:
    """Pairs of pages whose items have their nearest foreign item on each other, in both directions.

    ``nearest`` (page, best_page) has one row an item; ``sizes`` (page, n).  The score is the lesser of the shares."""
    counts = nearest.groupBy("page", "best_page").agg(F.count(F.lit(1)).alias("c"))
    s = sizes.where(F.col("n") >= least_size)
    a = counts.join(s.select("page", "n"), "page").join(s.select(F.col("page").alias("best_page")), "best_page").withColumn("share", F.col("c") / F.col("n"))
    back = a.select(F.col("page").alias("best_page"), F.col("best_page").alias("page"), F.col("share").alias("back"))
    score = F.least("share", "back")
    return a.where("page < best_page").join(back, ["page", "best_page"]).select(F.col("page").alias("a"), F.col("best_page").alias("b"), score.alias("score")).where(F.col("score") >= share)
