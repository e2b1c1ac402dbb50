"""Predicates and orders on article rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import keyword_terms, like_contains


def contains_filter(articles: DataFrame, query: str | None = None, category: str | None = None,
                    source: str | None = None, escape: bool = False) -> DataFrame:
    """Case-insensitive "contains" on title, summary or content, and on category and source.

    An empty argument does not filter.
    """
    out = articles
    if query:
        out = out.filter(like_contains("title", query, escape) |
                         like_contains("summary", query, escape) |
                         like_contains("content", query, escape))
    if category:
        out = out.filter(like_contains("category", category, escape))
    if source:
        out = out.filter(like_contains("source", source, escape))
    return out


def keyword_filter(articles: DataFrame, column: str, value: str, mode: str = "value") -> DataFrame:
    """Exact match on a keyword column, lower-cased.

    In ``token`` mode the column is split on white space and the value is not, so a
    value of several words never matches.
    """
    if mode == "value":
        return articles.filter(F.lower(column) == value.lower())
    return articles.filter(F.array_contains(keyword_terms(column, "token"), value.lower()))


def tag_filter(articles: DataFrame, value: str) -> DataFrame:
    return articles.filter(F.exists("tags", lambda t: F.lower(F.trim(t)) == value.strip().lower()))


def article_order(sort_by: str, tie: str = "article_id") -> list[Column]:
    """Order of a store search: ``date``/``published``, ``title``, anything else by creation."""
    if sort_by in ("date", "published"):
        return [F.col("published").desc_nulls_last(), F.col(tie)]
    if sort_by == "title":
        return [F.col("title").asc_nulls_last(), F.col(tie)]
    return [F.col("created_at").desc_nulls_last(), F.col(tie)]


def page_of(df: DataFrame, order: list[Column], page: int = 1, per_page: int = 20) -> DataFrame:
    """Rows of one page; a page past the end is empty."""
    if page < 1 or not 1 <= per_page <= 100:
        raise ValueError("page must be at least 1 and per_page between 1 and 100")
    return df.orderBy(*order).offset((page - 1) * per_page).limit(per_page)


def newest(df: DataFrame, column: str, limit: int, tie: str) -> DataFrame:
    """The ``limit`` newest rows: a top-k per task, then one small merge."""
    return df.orderBy(F.col(column).desc_nulls_last(), F.col(tie)).limit(limit)


def lookup(df: DataFrame, column: str, value) -> DataFrame:
    """At most one row by key; the comparison reaches the scan."""
    return df.filter(F.col(column) == F.lit(value)).limit(1)
