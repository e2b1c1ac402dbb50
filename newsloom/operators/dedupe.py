"""Keeping one row per article and only what is not stored yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import article_id


def with_article_id(entries: DataFrame) -> DataFrame:
    return entries.withColumn("article_id", article_id("title", "link"))


def first_per_article(df: DataFrame, order: tuple[str, ...] = ("published", "link"),
                      key: str = "article_id") -> DataFrame:
    """One row per ``key``: the first by ``order``.

    A hash of the other columns decides what ``order`` leaves open, so the result does not depend on
    how the input is cut into tasks.  Every map task lets only its own first row of a key through
    (Spark limits the window before the shuffle), so full rows are shuffled once and a key with many
    copies is no large group.  Rows that are equal in every column collapse.  ``order`` and the key
    must not be maps.
    """
    rest = [c for c in df.columns if c != key and c not in order]
    tie = F.xxhash64(*rest) if rest else F.lit(0).cast("long")
    place = Window.partitionBy(key).orderBy(*order, "_tie")
    return (df.withColumn("_tie", tie).withColumn("_row", F.row_number().over(place))
            .filter("_row = 1").select(*df.columns))


def not_stored(new: DataFrame, stored: DataFrame, key: str = "article_id") -> DataFrame:
    """Rows of ``new`` whose key is not in ``stored``.

    The stored ids are cut down to those of the batch first.  While the batch is
    small that semi-join is a broadcast of its ids and the history is scanned for
    one column and not shuffled; for a large batch it is a shuffle join on unique
    keys.  The choice is made from sizes measured at run time.
    """
    seen = stored.select(key).join(new.select(key), key, "left_semi")
    return new.join(seen, key, "left_anti")
