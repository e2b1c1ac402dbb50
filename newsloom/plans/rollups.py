"""Counts of a store that are kept, not counted: one row per feed, category and source and change.

Every batch adds its rows; a deletion, a new feed key and retention add rows of their own, with a
minus where articles go.  What is read are the sums, so totals and facets follow all changes without a
look at the articles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables

KEYS = ("feed_key", "category", "source")
_SCHEMA = "feed_key string, category string, source string, n long, ingest_batch long"


def of_articles(articles: DataFrame) -> DataFrame:
    return articles.groupBy(*KEYS).agg(F.count("*").alias("n"))


def write(rows: DataFrame, path: str, batch_id: int) -> None:
    """Keep the changes ``rows`` (feed_key, category, source, n) of a batch; a replay replaces them."""
    tables.write_batch(rows.select(*KEYS, F.col("n").cast("long").alias("n")).coalesce(1), path, batch_id)


def read(spark: SparkSession, path: str, before_batch: int | None = None) -> DataFrame:
    """``(feed_key, category, source, n)``: the sums that are not zero."""
    rows = spark.read.schema(_SCHEMA).parquet(path)
    if before_batch is not None:
        rows = rows.filter(F.col("ingest_batch") < before_batch)
    return rows.groupBy(*KEYS).agg(F.sum("n").alias("n")).filter("n <> 0")


def without_feeds(counts: DataFrame, keys: DataFrame) -> DataFrame:
    """The changes that deleting the feeds ``keys`` (key) makes."""
    gone = counts.join(keys.select(F.col("key").alias("feed_key")).distinct(), "feed_key", "left_semi")
    return gone.select(*KEYS, (-F.col("n")).alias("n"))


def with_new_keys(counts: DataFrame, renames: DataFrame) -> DataFrame:
    """The changes that accepted renames (key, new_key) make."""
    moved = counts.join(renames.select(F.col("key").alias("feed_key"), "new_key"), "feed_key")
    return moved.select("feed_key", "category", "source", (-F.col("n")).alias("n")).unionByName(
        moved.select(F.col("new_key").alias("feed_key"), "category", "source", "n"))


def difference(after: DataFrame, before: DataFrame) -> DataFrame:
    """The changes that lead from the counts ``before`` to those ``after``."""
    return (after.select(*KEYS, "n").unionByName(before.select(*KEYS, (-F.col("n")).alias("n")))
            .groupBy(*KEYS).agg(F.sum("n").alias("n")).filter("n <> 0"))


def article_count(counts: DataFrame) -> DataFrame:
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("article_count"))


def articles_per(counts: DataFrame, column: str) -> DataFrame:
    """Articles per value of a key column; the empty value is counted too."""
    return counts.groupBy(column).agg(F.sum("n").alias("article_count"))


def distinct_values(counts: DataFrame, column: str) -> DataFrame:
    return counts.select(column).filter(F.col(column) != "").distinct().orderBy(column)


def search_metadata(counts: DataFrame) -> DataFrame:
    """``(kind, value, article_count)`` of categories, sources and the total."""
    facets = counts.select("n", F.explode(F.array(
        F.struct(F.lit("category").alias("kind"), F.col("category").alias("value")),
        F.struct(F.lit("source").alias("kind"), F.col("source").alias("value")),
        F.struct(F.lit("total").alias("kind"), F.lit("").alias("value")))).alias("f")).select("n", "f.*")
    return (facets.filter("kind = 'total' OR value <> ''").groupBy("kind", "value")
            .agg(F.sum("n").alias("article_count")))


def feeds_with_counts(feeds: DataFrame, counts: DataFrame) -> DataFrame:
    """All feeds with their number of articles."""
    per_feed = counts.groupBy(F.col("feed_key").alias("key")).agg(F.sum("n").alias("n"))
    return feeds.join(per_feed, "key", "left").withColumn("article_count", F.coalesce("n", F.lit(0))).drop("n")


def feed_totals(feeds: DataFrame, counts: DataFrame) -> DataFrame:
    """One row of totals, as :func:`newsloom.operators.stats.feed_totals` counts them."""
    f = feeds.agg(F.count("*").alias("total_feeds"), F.count_if("active").alias("active_feeds"),
                  F.count_if(~F.col("active")).alias("inactive_feeds"))
    per_kind = search_metadata(counts).groupBy("kind").agg(F.count("*").alias("n"), F.sum("article_count").alias("total"))
    a = per_kind.agg(
        F.coalesce(F.max(F.when(F.col("kind") == "total", F.col("total"))), F.lit(0)).alias("total_articles"),
        F.coalesce(F.max(F.when(F.col("kind") == "category", F.col("n"))), F.lit(0)).alias("category_count"),
        F.coalesce(F.max(F.when(F.col("kind") == "source", F.col("n"))), F.lit(0)).alias("source_count"))
    row = a.select(F.struct("*").alias("row")).scalar()
    return f.select("*", *[row.getField(c).alias(c) for c in a.columns])
