"""Claim edges and their review (FLT, JOIN, AGG, SUB, PIP): filters, promotion, bridges, mentions, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RELATIONS = ("supports", "contradicts", "extends", "instantiates", "compares", "same_as")
STATUSES = ("candidate", "active", "rejected", "stale", "promoted")


def query(edges: DataFrame, node: str | None = None, relation: str | None = None, status: str | None = None, limit: int | None = None) -> DataFrame:
    """Edges by any of these; ``node`` may be at either end; newest first."""
    if relation is not None and relation not in RELATIONS:
        raise ValueError(f"unknown relation {relation}")
    out = edges
    for given, condition in ((node, (F.col("src") == node) | (F.col("tgt") == node)), (relation, F.col("relation") == relation), (status, F.col("status") == status)):
        out = out if given is None else out.where(condition)
    out = out.orderBy(F.desc("updated_at"), F.desc("id"))
    return out if limit is None else out.limit(limit)


def counts_by_relation(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


def transition(edges: DataFrame, chosen: Column, status: str) -> DataFrame:
    if status not in STATUSES:
        raise ValueError(f"unknown status {status}")
    return edges.withColumn("status", F.when(chosen, status).otherwise(F.col("status")))


def pages_of_both_ends(edges: DataFrame, refs: DataFrame, priority: dict[str, int]) -> DataFrame:
    """(id, page): for each edge the page of best kind that refers to both its ends; ``refs`` is (page, kind, stem)."""
    a = refs.select("page", "kind", F.col("stem").alias("src"))
    b = refs.select("page", F.col("stem").alias("tgt"))
    rank = F.coalesce(*[F.when(F.col("kind") == k, r) for k, r in priority.items()], F.lit(99))
    both = edges.join(a, "src").join(b, ["page", "tgt"]).withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(rank, "page")))
    return both.where("_r = 1").select("id", "page", "kind")


def bridges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(hub, relation, pair, n): edges between members of one hub from different categories; ``members`` is (hub, stem, category)."""
    s = members.select("hub", F.col("stem").alias("src"), F.col("category").alias("_a"))
    t = members.select("hub", F.col("stem").alias("tgt"), F.col("category").alias("_b"))
    both = edges.join(s, "src").join(t, ["hub", "tgt"]).where("_a <> _b")
    return both.groupBy("hub", "relation", F.array_join(F.array_sort(F.array("_a", "_b")), " / ").alias("pair")).agg(F.count(F.lit(1)).alias("n"))


def members(by_keyword: DataFrame, by_claim: DataFrame) -> DataFrame:
    """(stem, slug): a page belongs by keyword or by claim; the slug of the strongest signal, claims before keywords."""
    every = by_claim.select("stem", "slug", F.lit(0).alias("rank")).unionAll(by_keyword.select("stem", "slug", F.lit(1).alias("rank")))
    w = Window.partitionBy("stem").orderBy("rank", F.col("slug").asc_nulls_last())
    return every.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("stem", "slug", F.when(F.col("rank") == 0, "claim").otherwise("keyword").alias("by"))


def verified_links(drafted: DataFrame, known: DataFrame, allowed: DataFrame) -> DataFrame:
    """``state`` of each drafted (src, link): broken if unknown, unverified if not on the list, else ok."""
    k = known.select(F.col("key").alias("link"), F.lit(True).alias("_k")).distinct()
    a = allowed.select("src", "link", F.lit(True).alias("_a")).distinct()
    return drafted.join(k, "link", "left").join(a, ["src", "link"], "left").withColumn("state", F.when(F.col("_k").isNull(), "broken").when(F.col("_a").isNull(), "unverified").otherwise("ok")).drop("_k", "_a")


def two_way_missing(listed: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    """What is listed but not there, and there but not listed."""
    return listed.select(*on).join(present, on, "left_anti").withColumn("issue", F.lit("missing")).unionByName(present.select(*on).join(listed, on, "left_anti").withColumn("issue", F.lit("unlisted")))


def back_links(links: DataFrame, existing: DataFrame) -> DataFrame:
    """Reverse links still to write, with the relation turned round."""
    note = F.when(F.col("note").contains("cited by"), F.replace("note", F.lit("cited by"), F.lit("cites"))).when(F.col("note").contains("cites"), F.replace("note", F.lit("cites"), F.lit("cited by"))).otherwise("topical")
    turned = links.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), note.alias("note")).dropDuplicates(["src", "tgt"])
    return turned.join(existing.select("src", "tgt"), ["src", "tgt"], "left_anti")


def persist_scores(claims: DataFrame, scores: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Claims with new scores where there are some; scores without a claim are not inserted."""
    new = scores.select(*key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in columns])
    keep = [c for c in claims.columns if c not in columns]
    return claims.join(new, key, "left").select(*keep, *[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def backfill(rows: DataFrame, attempt: str, stem: str) -> DataFrame:
    """Null stems of an attempt take the one its other rows know."""
    known = rows.where(F.col(stem).isNotNull()).groupBy(attempt).agg(F.min(stem).alias("_known"))
    return rows.join(known, attempt, "left").withColumn(stem, F.coalesce(stem, "_known")).drop("_known")


def triage(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts by slug; what nobody judged is uncertain."""
    return candidates.join(verdicts, "slug", "left").withColumn("verdict", F.coalesce("verdict", F.lit("uncertain")))


def tally(rows: DataFrame, by: list[str], verdicts: list[str]) -> DataFrame:
    """One row a group with a column for each verdict; ``ok`` if no hard failure is among them."""
    out = rows.groupBy(*by).agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in verdicts], F.count(F.lit(1)).alias("total"))
    return out.withColumn("ok", F.col(verdicts[0]) == 0)


def citation_edges(references: DataFrame, citations: DataFrame) -> DataFrame:
    """Distinct (src, tgt) from references and, turned round, citations."""
    return references.select("src", "tgt").union(citations.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"))).distinct()


def recommendations(recommended: DataFrame, n_sources: int) -> DataFrame:
    """Works recommended from two pages and more: counts, sources, categories, share of all sources."""
    g = recommended.groupBy("doi").agg(F.countDistinct("src").alias("times"), F.countDistinct("category").alias("breadth"), F.array_sort(F.collect_set("category")).alias("categories"))
    return g.where("times >= 2").withColumn("share", F.round(F.col("times") / max(n_sources, 1), 6))
