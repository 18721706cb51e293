"""Joins with a rule of their own (JOIN): as-of by longest prefix, reconciliation, prioritised union, hubs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.operators.metric import small


def longest_prefix_asof(rows: DataFrame, key: str, rates: DataFrame, today: str) -> DataFrame:
    """Each distinct key with its rate: (prefix, until, ...) of the longest prefix, and among its dated rows the first
    not yet over, else the undated one.

    Prefixes are matched by equality with each head of the key, so the join stays a hash join on ``prefix``
    however many keys and rates there are."""
    keys = rows.select(key).where(F.col(key).isNotNull()).distinct()
    heads = keys.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(key), F.lit(1))), lambda n: F.substring(F.col(key), F.lit(1), n))).alias("prefix"))
    valid = rates.where(F.col("until").isNull() | (F.col("until") >= F.lit(today)))
    best = Window.partitionBy(key).orderBy(F.length("prefix").desc(), F.col("until").asc_nulls_last())
    return heads.join(valid, "prefix").withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")


def prioritised_union(sources: list[DataFrame], key: str, most: int | None = None) -> DataFrame:
    """Rows of all sources, the first source that has a key wins; ``source_rank`` tells it."""
    every = None
    for rank, s in enumerate(sources):
        s = s.withColumn("source_rank", F.lit(rank))
        every = s if every is None else every.unionByName(s, allowMissingColumns=True)
    first = every.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("source_rank"))).where("_n = 1").drop("_n")
    return first if most is None else first.orderBy("source_rank", key).limit(most)


def reconcile_endpoints(edges: DataFrame, live: DataFrame, node: str, version: Column) -> DataFrame:
    """``status``: stale-missing if an end isn't live, stale-version if the edge's version differs, else active."""
    known = live.select(F.col(node).alias("_node")).distinct()
    out = edges.join(known.withColumnRenamed("_node", "_s"), F.col("src") == F.col("_s"), "left").join(known.withColumnRenamed("_node", "_t"), F.col("tgt") == F.col("_t"), "left")
    status = F.when(F.col("_s").isNull() | F.col("_t").isNull(), "stale-missing").when(~version, "stale-version").otherwise("active")
    return out.withColumn("status", status).drop("_s", "_t")


def shared_hubs(edges: DataFrame, member_of: DataFrame) -> DataFrame:
    """Edges (src, tgt) under each hub that both ends belong to (node, hub), else under ``_no_hub_``."""
    hubs = member_of.groupBy("node").agg(F.collect_set("hub").alias("hubs"))  # a node's own hubs
    hubs = small(hubs, 100)
    none = F.array().cast(hubs.schema["hubs"].dataType)
    met = edges.select("src", "tgt").join(hubs.select(F.col("node").alias("src"), F.col("hubs").alias("_l")), "src", "left").join(hubs.select(F.col("node").alias("tgt"), F.col("hubs").alias("_r")), "tgt", "left")
    both = F.array_intersect(F.coalesce("_l", none), F.coalesce("_r", none))
    return met.select("src", "tgt", F.explode(F.when(F.size(both) > 0, both).otherwise(F.array(F.lit("_no_hub_")))).alias("hub"))


def same_work_reason(surname_a: Column, surname_b: Column, year_a: Column, year_b: Column, overlap: Column) -> Column:
    """Why two records are not the same work; null if they are.  What is unknown cannot speak against it."""
    return (
        F.when(surname_a.isNotNull() & surname_b.isNotNull() & (F.lower(surname_a) != F.lower(surname_b)), "author")
        .when(year_a.isNotNull() & year_b.isNotNull() & (F.abs(year_a - year_b) > 1), "year")
        .when(overlap.isNotNull() & (overlap < 0.5), "title")
        .when(overlap.isNull() & (surname_a.isNull() | surname_b.isNull()), "unjudgeable")
    )
