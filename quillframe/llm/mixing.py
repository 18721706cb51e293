"""Mixing sources to target weights by pivotal dependent rounding.

Every document gets a fractional number of copies, its source's target over its source's size.  The whole part is
taken as it is.  Fractional parts meet in pairs: a random transfer that keeps the pair's words makes one of
the two whole, and the other meets the next document.  So every document keeps its expected copies and
a source's words are off by less than one document at the end.  Each task works through one bucket of a
source and hands up one unsettled document; those meet again level by level, a reduction tree of
``fan`` children a node, until one is left a source, which a last draw settles.

Size: words of the text; a null text has none, and a document without words draws alone.  Draws
are hashes of seed, id, text, source, level and a number among equal rows, so reruns agree and equal rows spread over buckets.  Sources are taken by code point, null last, with the given
weights in turn.  A target above ``most`` times its source's size stops there and the excess is shared again
by weight.  Repeated rows, and rows without id, are documents of their own; an empty table gives an empty result.  Other columns
may have any name.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm.common import materialise, number_repeats, row_part, small_side, word_count

WEIGHTS = (1.0, 2.0, 3.0)
MOST_COPIES = 3
LEAST_BUCKET_ROWS = 1_000
FAN = 64
#: Ids pass Python as strings, as null ones would turn numbers into floats there.
_ROUNDED = "id string, src string, no_source boolean, size long, source_size long, target double, whole long, x double, u double, salt long, bucket long, settled boolean"


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``target`` for each row (no_source, src, source_size): shares by weight, none above ``most`` * source_size.

    Sources are met in the order of cap over weight: the first whose cap reaches the level of the rest
    fixes that level.  One row a source, so the windows over all of them are small."""
    by_name = Window.orderBy("no_source", "src")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    every = Window.partitionBy(F.lit(0))
    by_cap = every.orderBy(F.col("cap") / F.col("w"), "no_source", "src")
    s = sources.withColumn("w", w).withColumn("cap", (F.col("source_size") * most).cast("double"))
    s = s.withColumn("total", F.sum("source_size").over(every).cast("double"))
    capped = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("w").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("level", (F.col("total") - capped) / open_weight).withColumn("k", F.row_number().over(by_cap))
    found = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("k", "level"))).over(every)
    s = s.withColumn("found", found["level"])
    return s.select("no_source", "src", "source_size", "n", F.least(F.col("cap"), F.coalesce(F.col("found"), F.lit(0.0)) * F.col("w")).alias("target"))


def pivot(size: np.ndarray, x: np.ndarray, u: np.ndarray, eps: float = 1e-12) -> tuple[np.ndarray, int]:
    """Rounds ``x`` in order, keeping sum(size * x); returns it with the index that stays fractional, or -1."""
    x = x.copy()
    held = -1
    for i in range(len(x)):
        if x[i] <= eps or x[i] >= 1 - eps:
            x[i] = round(x[i])
        elif size[i] == 0:
            x[i] = float(u[i] < x[i])
        elif held < 0:
            held = i
        else:
            ratio = size[i] / size[held]
            up, down = min(1 - x[held], x[i] * ratio), min(x[held], (1 - x[i]) * ratio)
            move = up if u[i] * (up + down) < down else -down
            x[held] += move
            x[i] -= move / ratio
            for k in (held, i):
                if x[k] <= eps or x[k] >= 1 - eps:
                    x[k] = round(x[k])
            held = held if 0 < x[held] < 1 else i if 0 < x[i] < 1 else -1
    return x, held


def _round_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["u", "salt", "size"], kind="stable", ignore_index=True)
    x, held = pivot(rows["size"].to_numpy(float), rows["x"].to_numpy(float), rows["u"].to_numpy(float))
    settled = np.ones(len(rows), bool)
    if held >= 0:
        settled[held] = False
    return rows.assign(x=x, settled=settled)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 29, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", fan: int = FAN) -> DataFrame:
    """Every row with its copies: id_col, source, size, source_size, target, copies, taken."""

    def uniform(level: int):
        return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), F.col("salt")), 11)).cast("double") / float(1 << 53)

    rows = materialise(docs.select(
        F.col(id_col).cast("string").alias("id"), F.xxhash64(text_col).alias("th"), row_part().alias("part"), F.col(source_col).isNull().alias("no_source"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("src"),
        word_count(F.col(text_col)).alias("size"),
    ), "mix-rows")
    rows = number_repeats(rows, ["id", "th", "src", "no_source"]).withColumn("salt", F.xxhash64(F.lit(seed), "id", "th", "src", "nth"))
    sources = rows.groupBy("no_source", "src").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sources = materialise(source_targets(sources, weights, most), "mix-sources")
    n_sources, total, largest = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    bucket_rows = max(LEAST_BUCKET_ROWS, math.isqrt(total))
    p = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    spread = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("salt")), F.ceil(F.col("n") / bucket_rows))
    rows = rows.join(small_side(sources, n_sources, 96), ["no_source", "src"]).withColumn("p", p)
    rows = rows.select(
        "id", "src", "no_source", "size", "source_size", "target", F.floor("p").cast("long").alias("whole"), (F.col("p") - F.floor("p")).alias("x"),
        uniform(0).alias("u"), "salt", spread.cast("long").alias("bucket"), F.lit(False).alias("settled"),
    )
    done, level, buckets = [], 0, max(1, -(-largest // bucket_rows))
    while True:
        rows = materialise(rows.groupBy("no_source", "src", "bucket").applyInPandas(_round_bucket, _ROUNDED), f"mix-level-{level}")
        done.append(rows.where("settled"))
        rows, level = rows.where("not settled").withColumn("u", uniform(level + 1)), level + 1
        if buckets == 1:
            break
        buckets = -(-buckets // fan)
        rows = rows.withColumn("bucket", F.floor(F.col("bucket") / fan).cast("long"))
    done.append(rows.withColumn("x", (F.col("u") < F.col("x")).cast("double")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = F.col("whole") + F.round("x").cast("long")
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.when(~F.col("no_source"), F.col("src")).alias("source"), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
