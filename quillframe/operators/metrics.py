"""Retrieval metrics (IRM): reciprocal rank, importance nDCG, recall, from rankings and expected items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAINS = {"critical": 3.0, "important": 2.0, "nice": 1.0}


def rank_metrics(ranking: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """One row a query: mrr, ndcg, recall, critical_recall (1 when nothing is critical), hits.

    ``ranking`` (qid, key, rank), the first rank of a key counts; ``expected`` (qid, key, importance).  The reciprocal
    rank is that of the first critical hit, if there is one, else of the first hit."""
    first = ranking.groupBy("qid", "key").agg(F.min("rank").alias("rank")).where(F.col("rank") <= k)
    gain = F.coalesce(*[F.when(F.col("importance") == n, g) for n, g in GAINS.items()], F.lit(0.0))
    e = expected.withColumn("gain", gain)
    ideal_rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("gain"), "key"))
    e = e.withColumn("_i", ideal_rank).join(first, ["qid", "key"], "left")
    discount = lambda r: F.log2(r + 1)
    hit, critical = F.col("rank").isNotNull(), F.col("importance") == "critical"
    out = e.groupBy("qid").agg(
        F.sum(F.when(hit, F.col("gain") / discount(F.col("rank"))).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("_i") <= k, F.col("gain") / discount(F.col("_i"))).otherwise(0.0)).alias("ideal"),
        F.coalesce(F.min(F.when(critical, F.col("rank"))), F.min("rank")).alias("best"),
        F.count_if(hit).alias("hits"), F.count(F.lit(1)).alias("n"), F.count_if(critical).alias("n_critical"), F.count_if(critical & hit).alias("critical_hits"))
    return out.select(
        "qid", F.round(F.coalesce(1.0 / F.col("best"), F.lit(0.0)), 6).alias("mrr"), F.round(F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0), 6).alias("ndcg"),
        F.round(F.col("hits") / F.col("n"), 6).alias("recall"), F.round(F.when(F.col("n_critical") > 0, F.col("critical_hits") / F.col("n_critical")).otherwise(1.0), 6).alias("critical_recall"), "hits")
