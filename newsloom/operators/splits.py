"""Seeded ranks, hold-out split, folds and samples.

All of them put rows in the order of a hash of their id and the seed.  A global
rank per label does not need all rows of a label in one task: rows are numbered
inside narrow hash ranges, and a histogram of the ranges (a fixed number of rows per
label) tells how many rows come before each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_DIGITS = 3          # 16**3 hash ranges per label


def seeded_hash(row_id: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(row_id).cast("string"), F.lit(f"#{seed}")))


def _ranked(df: DataFrame, row_id: str, seed: int, label: str) -> DataFrame:
    """Adds ``rank`` (1-based, per label) and ``label_count``.  A null label is a label of its own."""
    # a null id has no hash of its own; it comes first
    hashed = (df.withColumn("_hash", F.coalesce(seeded_hash(row_id, seed), F.lit("")))
              .withColumn("_range", F.substring("_hash", 1, _DIGITS)))
    histogram = hashed.groupBy(label, "_range").agg(F.count("*").alias("_n"))
    by_label = Window.partitionBy(label)
    offsets = histogram.select(
        label, "_range",
        (F.sum("_n").over(by_label.orderBy("_range")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(by_label).alias("label_count"))
    inside = Window.partitionBy(label, "_range").orderBy("_hash", row_id)
    return (hashed.withColumn("_inside", F.row_number().over(inside))
            .join(offsets.withColumnsRenamed({label: "_label", "_range": "_offset_range"}),
                  F.col(label).eqNullSafe(F.col("_label")) & F.col("_range").eqNullSafe(F.col("_offset_range")))
            .withColumn("rank", F.col("_inside") + F.col("_before"))
            .drop("_hash", "_range", "_inside", "_before", "_label", "_offset_range"))


def stratified_split(df: DataFrame, row_id: str, label: str = "label", test_size: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Adds ``is_test``: of every label the exact share, rounded, by seeded order.

    Pass narrow rows (id and label); join the texts by id afterwards.
    """
    return (_ranked(df, row_id, seed, label)
            .withColumn("is_test", F.col("rank") <= F.round(F.col("label_count") * F.lit(test_size)))
            .drop("rank", "label_count"))


def stratified_folds(df: DataFrame, row_id: str, k: int = 5, label: str = "label",
                     seed: int = 42) -> DataFrame:
    """Adds ``fold`` in 0..k-1; folds of a label differ by at most one row."""
    return (_ranked(df, row_id, seed, label)
            .withColumn("fold", F.pmod(F.col("rank") - 1, F.lit(k)).cast("int"))
            .drop("rank", "label_count"))


def seeded_sample(df: DataFrame, row_id: str, size: int, seed: int = 42) -> DataFrame:
    """Exactly ``size`` rows by seeded order, or all rows when there are no more.

    A null id comes first; rows that share an id are rows of their own, in the order of a hash of all
    their columns.  A first pass over the ids finds the hash range in which row number ``size`` lies;
    rows of earlier ranges stay as they are, and only those of that range are put in order.
    """
    hashed = (df.withColumn("_hash", F.coalesce(seeded_hash(row_id, seed), F.lit("")))
              .withColumn("_range", F.substring("_hash", 1, _DIGITS)))
    histogram = hashed.groupBy("_range").agg(F.count("*").alias("_n"))
    running = histogram.withColumn("_sum", F.sum("_n").over(
        Window.partitionBy(F.lit(0)).orderBy("_range")))
    border = running.filter(F.col("_sum") >= size).orderBy("_range").limit(1).select(
        F.col("_range"), (F.lit(size) - F.col("_sum") + F.col("_n")).alias("take")).collect()  # at most one row
    if not border:
        return df
    last, take = border[0]
    columns = [F.to_json(c) if kind.startswith("map") else F.col(c) for c, kind in df.dtypes]
    inside = hashed.filter(F.col("_range") == last).orderBy("_hash", row_id, F.xxhash64(*columns)).limit(take)
    return hashed.filter(F.col("_range") < last).unionByName(inside).drop("_hash", "_range")
