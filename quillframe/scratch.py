"""Intermediate tables in the folder all executors share: plans stay short and rows survive lost executors."""

from __future__ import annotations

import contextvars
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scope: contextvars.ContextVar[tuple[str, ...]] = contextvars.ContextVar("scratch_scope", default=())


def scratch_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; if unset, an own folder on this machine where Spark runs on it alone, else an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quillframe-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _folder(spark: SparkSession, scope: tuple[str, ...]) -> str:
    return "/".join([scratch_dir(spark), spark.sparkContext.applicationId, *scope])


def drop(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_table(spark: SparkSession, files: list[str]) -> None:
    """Deletes the folder of a written table that nothing reads any more, given its files."""
    if files:
        drop(spark, files[0].rsplit("/", 1)[0])


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Tables written within it go when it ends; for a caller who has written the results elsewhere."""
    token = _scope.set((*_scope.get(), f"scope-{uuid.uuid4().hex}"))
    try:
        yield
    finally:
        drop(spark, _folder(spark, _scope.get()))
        _scope.reset(token)


def materialise(df: DataFrame, name: str, outside: bool = False) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back; ``outside`` the innermost scope if asked."""
    spark, scope = df.sparkSession, _scope.get()
    path = f"{_folder(spark, scope[:-1] if outside else scope)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
