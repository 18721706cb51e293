"""Data-quality rules (LNT): each is a predicate with a detail; the report is their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, Column, Column]


def report(ruled: tuple[DataFrame, list[Rule]], key: str) -> DataFrame:
    """(rule, key, detail) of every finding, in one pass over the rows however many rules there are."""
    rows, rules = ruled
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(name).alias("rule"), detail.cast("string").alias("detail"))) for name, bad, detail in rules]))
    return rows.select(key, F.explode(found).alias("_f")).select("_f.rule", key, "_f.detail")


def document_rules(rows: DataFrame) -> tuple[DataFrame, list[Rule]]:
    none = F.lit("")
    return rows, [
        ("missing-label", F.col("quality").isNull(), none),
        ("thin-text", F.col("n_chars") < 200, F.col("n_chars")),
        ("toxic-but-good", (F.col("toxic") == 1) & (F.col("quality") == 1), none),
        ("length-mismatch", F.length("text") != F.col("n_chars"), F.length("text")),
    ]


def page_rules(rows: DataFrame) -> tuple[DataFrame, list[Rule]]:
    """For pages with key, type, folder, category, doi, no_doi_reason, year, stem, keywords, hook, venue, body."""
    stem_year = F.regexp_extract("stem", r"-((?:19|20)\d\d)[a-z]?(?:-|$)", 1)
    placeholder = F.lower(F.trim(F.coalesce("doi", F.lit("")))).isin("", "todo", "none")
    ceiling = F.when(F.col("type") == "review", 300).otherwise(200)
    return rows, [
        ("type-folder", F.col("type") != F.col("folder"), F.concat_ws("/", "type", "folder")),
        ("missing-doi", placeholder & F.col("no_doi_reason").isNull(), F.coalesce("doi", F.lit(""))),
        ("stem-year", (stem_year != "") & (stem_year.cast("int") != F.col("year")), stem_year),
        ("few-keywords", F.size("keywords") < 5, F.size("keywords")),
        ("missing-hook", F.trim(F.coalesce("hook", F.lit(""))) == "", F.lit("")),
        ("long-hook", F.length("hook") > ceiling, F.length("hook")),
        ("none-beside-bullets", F.col("body").rlike(r"(?m)^\s*-\s*\(none\)\s*$") & F.col("body").rlike(r"(?m)^\s*-\s+(?!\(none\))\S"), F.lit("")),
    ]


def all_reports(*reports: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)
