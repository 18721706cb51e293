"""What the operators of this subpackage share: joins with a size check, word rules, and scratch tables from outside."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.scratch import drop_table, materialise, scratch_scope

__all__ = ["drop_table", "materialise", "scratch_scope"]

#: White space and words as every operator here understands them.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Texts that a Python worker gets at a time.
TEXT_ROWS = 1_000

#: A side of a join is broadcast only if rows * width is known to stay below this.
BROADCAST_LIMIT = 32 * 1024 * 1024


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, actions send Python at most so many rows at a time; for wide rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


_kept: dict[str, Any] = {}


def kept_in_worker(key: str, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task: one thing at a time, so that the caches of operators that follow each
    other don't add up."""
    if _kept.get("key") != key:
        _kept.clear()
        _kept.update(key=key, value=make())
    return _kept["value"]


def forget_kept() -> None:
    """For tasks that keep nothing: drops what an earlier operator's tasks left in this worker."""
    if _kept:
        _kept.clear()
        give_back()


def give_back() -> None:
    """Returns memory that Python and Arrow no longer use to the system; workers stay idle beside JVM stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def small_side(df: DataFrame, rows: int, width: int, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows of ``width`` bytes fit the limit, else as it is,
    so that Spark joins it by sort and merge, splitting skewed partitions."""
    return F.broadcast(df) if rows * width <= limit else df


def row_part() -> Column:
    """For the query that writes a table: which of its tasks wrote the row; ``number_repeats`` wants it as ``part``."""
    return F.shiftrightunsigned(F.monotonically_increasing_id(), 33)


def number_repeats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` of a written table with ``nth``: 0, 1, 2 .. among rows of equal keys, in any order.

    Rows are numbered within what one task wrote, behind the counts of tasks before it, so equal rows never meet in one
    task; and only rows that repeat are shuffled."""
    tagged = rows.withColumn("rkey", F.xxhash64(*keys))
    per = tagged.groupBy("rkey", "part").agg(F.count(F.lit(1)).alias("n"))
    often = materialise(per.groupBy("rkey").agg(F.sum("n").alias("of")).where("of > 1").select("rkey"), "repeats")
    n_often = often.count()
    if not n_often:
        return rows.withColumn("nth", F.lit(0).cast("long"))
    earlier = Window.partitionBy("rkey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = per.join(small_side(often, n_often, 16), "rkey", "left_semi").select("rkey", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    before = materialise(before, "repeats-before")
    told = tagged.join(small_side(before, before.count(), 32), ["rkey", "part"], "left")
    repeated = told.where("before is not null").withColumn("nth", F.col("before") + F.row_number().over(Window.partitionBy("rkey", "part").orderBy("rkey")) - 1)
    return told.where("before is null").withColumn("nth", F.lit(0)).unionByName(repeated).withColumn("nth", F.col("nth").cast("long")).drop("rkey", "before")


def word_count(text: Column) -> Column:
    """Words of a text as a long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
