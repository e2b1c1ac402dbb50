"""Labelled corpus: CSV in, prepared Parquet beside it."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from . import tables

PREPARATION_VERSION = 1


def read_corpus(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """CSV with header; quotes are doubled inside quotes, fields may hold line breaks.

    Without line breaks in fields (``multi_line=False``) a file is read in splits, else as one task.
    """
    return (spark.read.schema(schemas.CORPUS)
            .option("header", True).option("multiLine", multi_line)
            .option("quote", '"').option("escape", '"').csv(path))


def cache_path(cache_root: str, source_path: str) -> str:
    """One cache folder per source and version of the preparation."""
    key = hashlib.md5(f"{source_path}#{PREPARATION_VERSION}".encode()).hexdigest()
    return f"{cache_root}/prepared-{key}"


def _newest(df: DataFrame):
    return df.agg(F.max("_metadata.file_modification_time").alias("t")).first().t


def cached_or_prepare(spark: SparkSession, source_path: str, cache_root: str, prepare,
                      force: bool = False, multi_line: bool = True) -> DataFrame:
    """The prepared corpus; prepared anew unless a cache newer than the source exists.

    ``prepare`` is a function from the raw corpus to the prepared one.  What is
    returned is always read from the written table, so it is also the place
    where the lineage of training is cut.
    """
    target = cache_path(cache_root, source_path)
    fresh = False
    if not force and tables.exists(spark, target):
        source_time = _newest(spark.read.format("binaryFile").load(source_path).select("_metadata"))
        cached_time = _newest(spark.read.parquet(target).select("_metadata"))
        fresh = cached_time is not None and source_time is not None and cached_time > source_time
    if not fresh:
        # a file is one task; its rows are dealt out anew, by size, before the work on the texts
        prepare(read_corpus(spark, source_path, multi_line).hint("rebalance")).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)
