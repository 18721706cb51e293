"""Exact duplicates by progressive refinement, with DataFrame functions only.

Rows are grouped by the length of their normalised text, the groups of two and more by length and a
hash of the first characters, and only what is still together by a SHA-256 of the whole text.

Texts are equal if identical after every run of ``[\\x20\\x09-\\x0D]`` became one space.  A null text
counts as empty, so null, empty and, say, ``""`` fall together; ``" "`` differs from ``""``.  Of a group the
smallest id stays; null ids are larger than any other, and rows that share text and id share their fate.
An empty table gives an empty result.  Only the id and the text are looked at; other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import SPACE_RUN, materialise, small_side

PREFIX_CHARS = 256


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def _keyed(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int) -> DataFrame:
    norm = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    return norm.select("id", F.length("norm").alias("size"), F.xxhash64(F.substring("norm", 1, prefix_chars)).alias("prefix"), "norm")


def repeated_prefixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """(size, prefix) of two rows and more.

    The pass keeps 20 bytes a row.  Lengths, then prefixes, are counted with partial sums, so that no group meets in one task."""
    slim = materialise(_keyed(docs, id_col, text_col, prefix_chars).select("id", "size", "prefix"), "exact-slim")
    sizes = materialise(slim.groupBy("size").count().where("count > 1").select("size"), "exact-sizes")
    same_size = slim.join(small_side(sizes, sizes.count(), 8), "size", "left_semi")
    return materialise(same_size.groupBy("size", "prefix").count().where("count > 1").select("size", "prefix"), "exact-prefixes")


def duplicate_groups(docs: DataFrame, prefixes: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """The groups of two and more equal texts: digest, keep_id, group_size, from rows whose prefix group survived."""
    left = _keyed(docs, id_col, text_col, prefix_chars).join(small_side(prefixes, prefixes.count(), 24), ["size", "prefix"], "left_semi")
    digests = left.select("id", F.sha2("norm", 256).alias("digest"))
    groups = digests.groupBy("digest").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return materialise(groups.where("group_size > 1"), "exact-groups")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """Every row's decision: id_col, keep_id, group_size, kept, text_sha256."""
    groups = duplicate_groups(docs, repeated_prefixes(docs, id_col, text_col, prefix_chars), id_col, text_col, prefix_chars)
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(normalised(F.col(text_col)), 256).alias("digest"))
    told = rows.join(small_side(groups, groups.count(), 96), "digest", "left")
    return told.select(
        F.col("id").alias(id_col),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("group_size").isNull() | F.col("id").eqNullSafe(F.col("keep_id")), F.lit(True)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """``docs`` without the rows whose text a row with a smaller id has; all columns stay as they are.

    Repeats of one id with one text are one document, of which one row stays."""
    prefixes = repeated_prefixes(docs, id_col, text_col, prefix_chars)
    groups = duplicate_groups(docs, prefixes, id_col, text_col, prefix_chars)
    names = docs.columns
    # Columns of our own behind a prefix that no column of the table has.
    tag = "_x" * (1 + max([0, *map(len, names)]))
    size, prefix, digest, keep, group = (tag + c for c in ("size", "prefix", "digest", "keep", "group"))
    prefixes = prefixes.select(F.col("size").alias(size), F.col("prefix").alias(prefix), F.lit(True).alias(group))
    norm = normalised(F.col(text_col))
    rows = docs.withColumns({size: F.length(norm), prefix: F.xxhash64(F.substring(norm, 1, prefix_chars))}).join(small_side(prefixes, prefixes.count(), 24), [size, prefix], "left")
    # Whole texts are only hashed where another row has the prefix.
    rows = rows.withColumn(digest, F.when(F.col(group), F.sha2(norm, 256))).select(*names, digest)
    groups = groups.select(F.col("digest").alias(digest), F.col("keep_id").alias(keep), F.lit(True).alias(group))
    joined = rows.join(small_side(groups, groups.count(), 96), digest, "left")
    alone = F.col(group).isNull()
    keepers = joined.where(~alone & F.col(id_col).eqNullSafe(F.col(keep)))
    return joined.where(alone).select(*names).unionAll(keepers.dropDuplicates([digest]).select(*names))
