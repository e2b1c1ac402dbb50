"""Retention: keep the newest rows of every key, of the others drop the old ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_expiry(df: DataFrame, ts: str, row_id: str, cutoff: Column, keep_count: int = 10,
                key: str | None = None, last: DataFrame | None = None) -> DataFrame:
    """Adds ``expired``: beyond the newest ``keep_count`` of its key and before ``cutoff``.

    Only the place of the ``keep_count``-th newest row per key matters.  It comes from
    a row-number window limited to ``keep_count``: Spark cuts every task's share to
    that many rows per key before the shuffle, so a key with a third of all rows costs
    no more than others.  The full table then meets one small row per key.  Rows with a null
    key are a group of their own, and expire as others do.  ``last`` are these small rows
    (:func:`last_kept`), if they have been computed already.
    """
    order = [F.col(ts).desc_nulls_last(), F.col(row_id).desc()]
    place = F.struct(ts, row_id)
    if key is None:                      # one group: a top-k and a comparison, no join
        last = df.select(ts, row_id).orderBy(*order).limit(keep_count).agg(F.min(place).alias("l")).scalar()
        return df.withColumn("expired", F.coalesce((place < last) & (F.col(ts) < cutoff), F.lit(False)))
    last = last_kept(df, ts, row_id, keep_count, key) if last is None else last
    expired = (place < F.col("_last")) & (F.col(ts) < cutoff)
    return (df.join(last, F.col(key).eqNullSafe(F.col("_key")), "left")
            .withColumn("expired", F.coalesce(expired, F.lit(False))).select(*df.columns, "expired"))


def last_kept(df: DataFrame, ts: str, row_id: str, keep_count: int, key: str) -> DataFrame:
    """``(_key, _last)``: the place of the ``keep_count``-th newest row of every key, or of its last one."""
    newest = (df.select(key, ts, row_id)
              .withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.col(ts).desc_nulls_last(), F.col(row_id).desc())))
              .filter(F.col("rn") <= keep_count))
    return newest.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(ts, row_id)).alias("_last"))


def retain(df: DataFrame, ts: str, row_id: str, cutoff: Column, keep_count: int = 10,
           key: str | None = None, last: DataFrame | None = None) -> DataFrame:
    return with_expiry(df, ts, row_id, cutoff, keep_count, key, last).filter(~F.col("expired")).drop("expired")
