"""Pages in Markdown with a front matter (SRC): scans, fields, sections, claims.

Front matter is read as flat ``key: value`` lines, lists in brackets or as ``- item`` lines below their key; what
doesn't parse is an empty map, a page without a fence is dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.functions import text as T

FENCE = r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n(.*))?\z"
SECTIONS = ("Summary", "Key Contributions", "Results", "Limitations")


def scan(spark: SparkSession, folder: str, glob: str = "*.md") -> DataFrame:
    """path, modified, raw of every page below a folder; one row a file, so files stay whole."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("raw"))


def parsed(pages: DataFrame) -> DataFrame:
    """Adds stem, fields (map of strings, lists joined by newline) and body."""
    fenced = pages.where(F.col("raw").rlike(FENCE))
    head = F.regexp_extract("raw", FENCE, 1)
    # A list below a key becomes part of its line before lines are split.
    flat = F.regexp_replace(head, r"\n[ \t]*-[ \t]+", "\u0001")
    lines = F.filter(F.split(flat, "\n"), lambda x: x.rlike(r"^[A-Za-z_][A-Za-z0-9_-]*[ \t]*:"))
    key = lambda x: F.lower(F.trim(F.substring_index(x, ":", 1)))
    value = lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), "^[\"']|[\"']$", "")
    entries = F.transform(lines, lambda x: F.struct(key(x).alias("key"), value(x).alias("value")))
    # Of repeated keys the last holds, as with any map.
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    stem = F.regexp_extract("path", r"([^/]*)\.md$", 1)
    return fenced.select("*", stem.alias("stem"), F.map_from_entries(last).alias("fields"), F.coalesce(F.regexp_extract("raw", FENCE, 2), F.lit("")).alias("body"))


def list_field(value: Column) -> Column:
    """Items of a list in any of its forms: below each other, in brackets, or by comma."""
    inner = F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), "\u0001", ","), r"^\[|\]$", "")
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", "")), lambda x: x != "")


def claims(pages: DataFrame, sections: tuple[str, ...] = SECTIONS) -> DataFrame:
    """stem, section, position, text, is_cross_ref: bullets and table rows of these sections, ten characters and more."""
    parts = F.array(*[F.struct(F.lit(s).alias("section"), T.section(F.col("body"), s).alias("part")) for s in sections])
    rows = pages.select("stem", F.explode(parts).alias("s")).select("stem", "s.section", F.posexplode(F.split("s.part", "\n")).alias("line", "raw"))
    bullet = F.regexp_extract("raw", r"^[ \t]*[-*+][ \t]+(.*\S)", 1)
    cells = F.regexp_extract("raw", r"^[ \t]*\|(.*)\|[ \t]*$", 1)
    table = F.when(cells.rlike(r"^[ \t:|-]*$"), "").otherwise(F.trim(F.regexp_replace(cells, r"[ \t]*\|[ \t]*", "; ")))
    plain = T.strip_markdown(F.when(bullet != "", bullet).otherwise(table))
    found = rows.withColumn("text", plain).where(F.length("text") >= 10)
    number = F.row_number().over(Window.partitionBy("stem", "section").orderBy("line")) - 1
    return found.select("stem", "section", number.alias("position"), "text", F.col("raw").contains("[[").alias("is_cross_ref"))


def links(pages: DataFrame) -> DataFrame:
    """src, link: every wiki link of a page."""
    return pages.select(F.col("stem").alias("src"), F.explode(T.wikilinks(F.col("body"))).alias("link"))
