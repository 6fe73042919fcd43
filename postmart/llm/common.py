"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postmart.session import checkpoint_dir

#: What separates words: space, and the control characters from tab to carriage return.
SEPARATORS = "[\\x20\\x09-\\x0D]+"


class Scratch:
    """A folder of intermediate tables below ``spark.checkpoint.dir``.

    Tables are written by executors and read back by anyone, so that a lost executor costs a task, not the
    job.  ``drop`` removes a table that is no longer read; the rest goes when the session's JVM ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        path, fs = self._fs(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _fs(self, where: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def store(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        path, fs = self._fs(f"{self.root}/{name}")
        fs.delete(path, True)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str = "text") -> Column:
    """Number of words of a text, 0 for NULL."""
    return F.size(F.array_remove(F.split(text_or_empty(column), SEPARATORS), "")).cast("bigint")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_lower(column: str) -> str:
    """DuckDB text for lower-casing A-Z only."""
    return f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
