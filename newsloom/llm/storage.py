"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path


_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def stored(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` under a fresh path, or the one given, and read it again: later steps start from there."""
    if path is None:
        path = scratch_path(df.sparkSession, label)
        if (made := _passing.get()) is not None:
            made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Removes at the end, also after a failure, the tables that :func:`stored` has named itself inside.

    Only for jobs whose result has been written by then: what is read lazily later is gone.
    """
    made: list[str] = []
    token = _passing.set(made)
    try:
        yield
    finally:
        _passing.reset(token)
        for name in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Options of the session that hold for the jobs inside."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def stored_by_batches(df: DataFrame, label: str, rows: int) -> DataFrame:
    """:func:`stored`, with at most ``rows`` rows in an Arrow batch: for rows that are large."""
    with settings(df.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)}):
        return stored(df, label)
