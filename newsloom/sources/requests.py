"""Texts to be scored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def from_records(df: DataFrame, idx: str = "idx", title: str | None = "title",
                 content: str = "content") -> DataFrame:
    """``(idx, title, content)``; a bare text (``title=None``) has an empty title."""
    head = F.coalesce(F.col(title), F.lit("")) if title else F.lit("")
    return df.select(F.col(idx).cast("long").alias("idx"), head.alias("title"),
                     F.col(content).alias("content"))


def from_pages(extracted: DataFrame) -> DataFrame:
    """Extracted pages as score requests; their errors travel along."""
    return extracted.select(F.col("page_id").alias("idx"), "url", "title", "content", "error")
