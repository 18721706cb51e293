"""Migration of foreign pages (STR, PIP): aliases of keys and headings, renamed links, a ladder of verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mapped_keys(pages: DataFrame, aliases: DataFrame) -> DataFrame:
    """(stem, key, value, conflict): fields (map) under their canonical names (alias, key); unknown keys stay.

    A key that several aliases give different values conflicts, and takes none of them."""
    entries = pages.select("stem", F.explode(F.map_entries("fields")).alias("e")).select("stem", F.lower(F.regexp_replace("e.key", r"[\s_-]+", "_")).alias("alias"), F.trim("e.value").alias("value"))
    named = entries.join(aliases, "alias", "left").withColumn("key", F.coalesce("key", "alias"))
    g = named.where("value <> ''").groupBy("stem", "key").agg(F.count_distinct("value").alias("_n"), F.min("value").alias("value"))
    return g.select("stem", "key", F.when(F.col("_n") == 1, F.col("value")).alias("value"), (F.col("_n") > 1).alias("conflict"))


def year_of(value: Column) -> Column:
    return F.nullif(F.regexp_extract(value, r"(?:^|\D)((?:19|20)\d\d)(?:\D|$)", 1), F.lit("")).cast("int")


def heading_plan(headings: DataFrame, aliases: DataFrame) -> DataFrame:
    """(stem, position, heading) with the canonical name and how to get there: same, rename, merge (a second one of
    a page goes into the first), or unknown."""
    from pyspark.sql import Window

    plain = F.trim(F.regexp_replace(F.lower("heading"), r"[^\p{L}\p{N} ]+", ""))
    known = headings.withColumn("alias", plain).join(aliases, "alias", "left")
    nth = F.row_number().over(Window.partitionBy("stem", "canonical").orderBy("position"))
    how = F.when(F.col("canonical").isNull(), "unknown").when(nth > 1, "merge").when(F.col("canonical") == F.col("heading"), "same").otherwise("rename")
    return known.select("stem", "position", "heading", "canonical", how.alias("how"))


def relinked(links: DataFrame, renamed: DataFrame) -> DataFrame:
    """Links (src, link) under the new names (old, new) of their targets; both ends follow."""
    r = renamed.select(F.col("old").alias("link"), F.col("new").alias("_l"))
    s = renamed.select(F.col("old").alias("src"), F.col("new").alias("_s"))
    return links.join(r, "link", "left").join(s, "src", "left").select(F.coalesce("_s", "src").alias("src"), F.coalesce("_l", "link").alias("link")).distinct()


def verdict(readable: Column, duplicate: Column, conflicts: Column, missing: Column, fixable: Column) -> Column:
    """blocked, duplicate, needs-human, compliant or fixable, the first that fits."""
    return F.when(~readable, "blocked").when(duplicate, "duplicate").when((conflicts > 0) | (missing > fixable), "needs-human").when(missing == 0, "compliant").otherwise("fixable")
