"""Rows as JSON with ISO times (the public form of the three tables)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Public fields of each table, in order.
ARTICLE_FIELDS = ("title", "summary", "content", "link", "published", "source", "category",
                  "author", "tags", "created_at", "feed_key")
FEED_FIELDS = ("key", "name", "url", "category", "active", "created_at", "updated_at",
               "last_fetched_at", "last_fetch_status", "last_fetch_error", "last_articles_count",
               "feed_title", "feed_description", "feed_updated")
LOG_FIELDS = ("feed_key", "started_at", "completed_at", "status", "articles_found",
              "articles_new", "articles_updated", "error_message", "feed_entries_count",
              "feed_metadata")


def iso_time(name: str, kind: str) -> Column:
    """ISO text with six digits of fraction; zoned times carry their offset."""
    if kind == "timestamp":
        return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def to_json_rows(df: DataFrame, id_column: str, fields: tuple[str, ...]) -> DataFrame:
    """``(id, json)``; nulls stay in the text, missing tags become an empty list."""
    kinds = dict(df.dtypes)
    parts = [F.col(id_column).alias("id")]
    for name in fields:
        if kinds[name].startswith("timestamp"):
            parts.append(iso_time(name, kinds[name]).alias(name))
        elif name == "tags":
            parts.append(F.coalesce(name, F.array().cast("array<string>")).alias(name))
        else:
            parts.append(F.col(name))
    return df.select(F.col(id_column).alias("id"),
                     F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("json"))


def articles_json(articles: DataFrame) -> DataFrame:
    return to_json_rows(articles, "article_id", ARTICLE_FIELDS)


def feeds_json(feeds: DataFrame) -> DataFrame:
    return to_json_rows(feeds, "key", FEED_FIELDS)


def logs_json(logs: DataFrame) -> DataFrame:
    return to_json_rows(logs, "run_id", LOG_FIELDS)
