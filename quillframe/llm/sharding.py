"""Shards that all have the mixture of the whole, with DataFrame functions only.

Proportional stratified interleaving: within each source rows are ranked by a seeded hash of their id and text (and a number among equal rows, which so spread); the
row of rank r among n gets the fractional rank (r - 1/2) / n; all rows, sorted by it, are cut into shards of
equal counts (the ``rows`` law: counts differ by one at most).  Every stretch of that order has each
source in proportion.

Ranks are counted without a sort of a whole source in one task: rows fall into buckets of the hash (or of
the fractional rank) of about ``bucket_rows`` rows, whatever their source's share, bucket counts are summed,
and rows are numbered within their bucket.  By default a bucket has as many rows as there are buckets, so
that both the numbering and the one task that sums the counts stay small.  A null source is a source; a null text has no bytes; rows that
repeat are rows of their own.  Equal texts are not kept together: a large group would break the law.  An
empty table gives an empty result.  Only id, text and source are looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm.common import materialise, number_repeats, row_part, small_side

FIXED_BYTES = 8
LEAST_BUCKET_ROWS = 1_000


def _before(counts: DataFrame, per: list[str], bucket: str) -> DataFrame:
    """Bucket counts with the number of rows in earlier buckets; one row a bucket, so small beside the data."""
    earlier = Window.partitionBy(*per).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def interleave_shards(docs: DataFrame, shards: int = 24, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", bucket_rows: int | None = None) -> DataFrame:
    """Every row's place: id_col, size, text_crc32, source, shard, slot."""
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).isNull().alias("no_source"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("src"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + FIXED_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).cast("long").alias("crc"),
        row_part().alias("part"),
    )
    rows = number_repeats(materialise(rows, "shard-rows"), ["id", "crc", "size", "src", "no_source"]).withColumn("h", F.xxhash64(F.lit(seed), "id", "crc", "nth"))
    sources = materialise(docs.select(F.col(source_col).isNull().alias("no_source"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("src")).groupBy("no_source", "src").agg(F.count(F.lit(1)).alias("of")), "shard-sources")
    n_sources, total = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("of"), F.lit(0))).first()
    bucket_rows = bucket_rows or max(LEAST_BUCKET_ROWS, math.isqrt(total))
    # The bucket of a hash: its upper 31 bits, scaled to the buckets of its source.
    buckets = F.ceil(F.col("of") / bucket_rows)
    upper = F.shiftright("h", 33) + F.lit(1 << 30)
    rows = rows.join(small_side(sources, n_sources, 64), ["no_source", "src"]).withColumn("b", F.floor(upper * buckets / F.lit(float(1 << 31))).cast("long"))
    slim = materialise(rows, "shard-slim")
    counts = materialise(_before(slim.groupBy("no_source", "src", "b").agg(F.count(F.lit(1)).alias("n")), ["no_source", "src"], "b").drop("n"), "shard-counts")
    in_bucket = F.row_number().over(Window.partitionBy("no_source", "src", "b").orderBy("h", "id", "crc", "size"))
    ranked = slim.withColumn("r", in_bucket).join(small_side(counts, counts.count(), 80), ["no_source", "src", "b"])
    strips = max(1, -(-total // bucket_rows))
    ranked = ranked.withColumn("frac", (F.col("r") + F.col("before") - F.lit(0.5)) / F.col("of"))
    ranked = materialise(ranked.select("id", "no_source", "src", "size", "crc", "h", "frac", F.floor(F.col("frac") * strips).cast("long").alias("strip")), "shard-ranked")
    strip_counts = _before(ranked.groupBy("strip").agg(F.count(F.lit(1)).alias("n")), [], "strip").drop("n")
    in_strip = F.row_number().over(Window.partitionBy("strip").orderBy("frac", "no_source", "src", "h", "id", "crc", "size"))
    placed = ranked.withColumn("r", in_strip).join(small_side(strip_counts, strips, 32), "strip")
    at = F.col("r") + F.col("before") - 1
    # Position p of N lies in shard p*K div N, which starts at the ceiling of shard*N/K.
    placed = placed.withColumn("at", at.cast("long")).withColumn("shard", F.expr(f"(at * {shards}L) div {max(total, 1)}L"))
    start = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return placed.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.when(~F.col("no_source"), F.col("src")).alias("source"),
        F.col("shard").cast("int").alias("shard"), (F.col("at") - start).cast("long").alias("slot"),
    )
