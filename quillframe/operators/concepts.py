"""Concept mining (AGG, STR): candidate terms from keywords and text, folded by canonical key, ranked and labelled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions import text as T
from quillframe.operators.metric import small


def keyword_candidates(keywords: DataFrame, least: int = 3) -> DataFrame:
    """From (page, category, term): groups by slug, folds slugs of one canonical key that share a page, keeps the longest
    form, and ranks by pages * sqrt(categories).

    A slug folds into its key only if it occurs beside another form of that key on some page; else it stays itself."""
    t = keywords.withColumn("slug", T.slugify(F.col("term"))).where(F.col("slug") != "").withColumn("key", T.canonical_key(F.col("slug")))
    forms = t.select("page", "key", "slug").distinct().withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("page", "key")))
    together = forms.where("_n > 1").select("key", "slug").distinct().withColumn("_folds", F.lit(True))
    t = t.join(together, ["key", "slug"], "left").withColumn("key", F.when(F.col("_folds"), F.col("key")).otherwise(F.col("slug")))
    out = t.groupBy("key").agg(F.countDistinct("page").alias("pages"), F.countDistinct("category").alias("categories"), F.max(F.struct(F.length("term").alias("len"), F.col("term"))).alias("_t"))
    rank = F.round(F.col("pages") * F.sqrt(F.greatest("categories", F.lit(1))), 6)
    return out.where(F.col("pages") >= least).select("key", F.col("_t.term").alias("term"), "pages", "categories", rank.alias("weight"))


def text_candidates(rows: DataFrame, terms: Column, weight: Column, least: int = 3) -> DataFrame:
    """From (page, category, section) and its terms: distinct pages and categories, and weights once a (page, section)."""
    t = rows.select("page", "category", "section", weight.alias("w"), F.explode(terms).alias("term")).dropDuplicates(["page", "section", "term"])
    out = t.groupBy("term").agg(F.countDistinct("page").alias("pages"), F.countDistinct("category").alias("categories"), F.round(F.sum("w"), 6).alias("weighted"))
    return out.where(F.col("pages") >= least)


def tier(term: Column, pages: Column, categories: Column, corpus: int, deep: int = 5) -> Column:
    """glossary (an acronym on at least 10 and over 5 percent of the pages), bridge (two categories and more), deep, candidate."""
    glossary = term.rlike("^[A-Z0-9][A-Z0-9-]{1,9}$") & (pages >= 10) & (pages > 0.05 * corpus)
    return F.when(glossary, "glossary").when(categories >= 2, "bridge").when(pages >= deep, "deep").otherwise("candidate")


def merge_sources(candidates: DataFrame) -> DataFrame:
    """One row a key of (key, term, source_rank, pages, categories): the best source's term, the greatest counts."""
    best = Window.partitionBy("key").orderBy("source_rank", F.desc("pages"), F.desc(F.length("term")), "term")
    all_of = Window.partitionBy("key")
    return candidates.select("*", F.row_number().over(best).alias("_r"), F.max("pages").over(all_of).alias("_p"), F.max("categories").over(all_of).alias("_c")).where("_r = 1").select("key", "term", "source_rank", F.col("_p").alias("pages"), F.col("_c").alias("categories"))


def mentions(rows: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(key, term): texts that hold a term as whole words; terms (term) of one to four words.

    Texts are cut into word n-grams of the lengths asked for, which meet the terms by equality, so there is no text-by-term product.  Terms
    are broadcast as long as they are few, so that only what is found is shuffled."""
    asked = terms.select("term", T.tokens(F.col("term")).alias("_t")).select("term", F.size("_t").alias("_n"), F.array_join("_t", " ").alias("_g")).where("_n between 1 and 4")
    lengths = sorted(r[0] for r in asked.select("_n").distinct().collect())  # four at most
    # The words are a column of their own, so that they aren't cut anew for each n-gram.
    worded = rows.select(key, T.tokens(F.col(text)).alias("_w"))
    grams = F.concat(F.array().cast("array<string>"), *[F.array_distinct("_w") if n == 1 else T.ngrams(F.col("_w"), n) for n in lengths])
    return worded.select(key, F.explode(grams).alias("_g")).join(small(asked.drop("_n"), 64), "_g").select(key, "term").distinct()
