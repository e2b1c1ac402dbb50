"""Row quality: every row keeps its reasons, nothing is dropped silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_URL = r"(?i)^(https?|ftps?)://[^\s/?#]+\.[^\s/?#]+([/?#]\S*)?$"


def _reasons(**checks: Column) -> Column:
    """Names of the checks that fail; a check that is null fails."""
    found = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]
    return F.filter(F.array(*found), lambda r: r.isNotNull())


def is_url(column) -> Column:
    return F.col(column).rlike(_URL)


def check_feeds(feeds: DataFrame) -> DataFrame:
    """Adds ``reasons``; ``active`` defaults to true."""
    return (feeds.withColumn("active", F.coalesce("active", F.lit(True)))
            .withColumn("reasons", _reasons(
                key_missing=F.length("key") > 0, name_missing=F.length("name") > 0,
                url_invalid=is_url("url"), category_missing=F.length("category") > 0)))


def check_articles(articles: DataFrame) -> DataFrame:
    """Adds ``reasons``; missing tags become an empty list.  Off by default in ingest."""
    return (articles.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
            .withColumn("reasons", _reasons(
                title_length=F.length("title").between(1, 500), link_invalid=is_url("link"),
                source_missing=F.col("source").isNotNull(),
                category_missing=F.col("category").isNotNull())))


def check_texts(requests: DataFrame) -> DataFrame:
    """Adds ``error`` (null when the text can be scored); a null title counts as empty."""
    blank = F.regexp_replace(F.coalesce("content", F.lit("")), r"(?U)\s+", "") == ""
    return (requests.withColumn("title", F.coalesce("title", F.lit("")))
            .withColumn("error", F.when(blank, "No text provided for prediction")))


def good(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("reasons") == 0).drop("reasons")


def bad(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("reasons") > 0)
