"""Counts and facets.  Every operator is one partial and one final aggregate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def article_count(articles: DataFrame) -> DataFrame:
    return articles.agg(F.count("*").alias("article_count"))


def article_count_by_feed(articles: DataFrame, feed_key: str) -> DataFrame:
    return article_count(articles.filter(F.col("feed_key") == feed_key))


def distinct_values(articles: DataFrame, column: str) -> DataFrame:
    """Distinct non-empty values in code-point order."""
    return articles.select(column).filter(F.col(column) != "").distinct().orderBy(column)


def articles_per(articles: DataFrame, column: str) -> DataFrame:
    """Articles per value; the empty value is counted too."""
    return articles.groupBy(column).agg(F.count("*").alias("article_count"))


def search_metadata(articles: DataFrame) -> DataFrame:
    """Categories, sources and the total in one scan: ``(kind, value, article_count)``.

    One row per value instead of one row of lists, so nothing is gathered in one place.
    """
    facets = articles.select(F.explode(F.array(
        F.struct(F.lit("category").alias("kind"), F.col("category").alias("value")),
        F.struct(F.lit("source").alias("kind"), F.col("source").alias("value")),
        F.struct(F.lit("total").alias("kind"), F.lit("").alias("value")))).alias("f")).select("f.*")
    return (facets.filter("kind = 'total' OR value <> ''")
            .groupBy("kind", "value").agg(F.count("*").alias("article_count")))


def feed_totals(feeds: DataFrame, articles: DataFrame) -> DataFrame:
    """One row of totals over the two tables."""
    f = feeds.agg(F.count("*").alias("total_feeds"),
                  F.count_if("active").alias("active_feeds"),
                  F.count_if(~F.col("active")).alias("inactive_feeds"))
    # distinct values per kind first, so that no task sees all values of a column
    per_kind = (search_metadata(articles).groupBy("kind")
                .agg(F.count("*").alias("n"), F.sum("article_count").alias("total")))
    a = per_kind.agg(
        F.coalesce(F.max(F.when(F.col("kind") == "total", F.col("total"))), F.lit(0)).alias("total_articles"),
        F.coalesce(F.max(F.when(F.col("kind") == "category", F.col("n"))), F.lit(0)).alias("category_count"),
        F.coalesce(F.max(F.when(F.col("kind") == "source", F.col("n"))), F.lit(0)).alias("source_count"))
    row = a.select(F.struct("*").alias("row")).scalar()
    return f.select("*", *[row.getField(c).alias(c) for c in a.columns])


def database_stats(feeds: DataFrame, articles: DataFrame, logs: DataFrame) -> DataFrame:
    """``(name, value)`` rows: size of each table and the active feeds."""
    def row(name, df):
        return df.agg(F.count("*").alias("value")).select(F.lit(name).alias("name"), "value")

    parts = [row("feeds_count", feeds), row("articles_count", articles),
             row("update_logs_count", logs), row("active_feeds", feeds.filter("active"))]
    return reduce(DataFrame.unionByName, parts)


def null_counts(df: DataFrame) -> DataFrame:
    """``(column_name, nulls)`` for every column, in one pass."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return one.unpivot([], df.columns, "column_name", "nulls")


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    return counts.withColumn("percent", F.round(F.col("n") * 100.0 / total, 4))
