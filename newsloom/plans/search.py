"""One entry point for article searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import contains, filters, search
from ..operators.postings import SearchIndex
from ..operators.search import SearchSpec


def search_articles(articles: DataFrame, spec: SearchSpec, index: SearchIndex | None = None,
                    engine: str | None = None, grams: str | None = None) -> DataFrame:
    """One page of article rows; with ``score`` when ranked.

    ``engine`` is ``ranked`` (needs an index) or ``contains``; by default the index is used when
    there is one.  ``contains`` scans ``articles``, or reads what :mod:`..operators.contains`
    has stored of them at ``grams``.
    """
    engine = engine or ("ranked" if index is not None else "contains")
    if engine == "ranked":
        if index is None:
            raise ValueError("a ranked search needs an index")
        return search.with_stored_fields(search.search_ids(index, spec), articles)
    if engine != "contains":
        raise ValueError(f"unknown engine {engine!r}")
    if grams is None:
        rows = filters.contains_filter(articles, spec.query, spec.category, spec.source)
    else:
        rows = contains.search_contains(articles.sparkSession, grams, articles.schema, spec.query, spec.category, spec.source)
    return filters.page_of(rows, filters.article_order(spec.sort_by), spec.page, spec.per_page)


def search_total(articles: DataFrame, spec: SearchSpec, index: SearchIndex | None = None) -> DataFrame:
    """Number of hits before paging, as a second job."""
    if index is not None:
        return search.total_hits(search.match_all(index, spec))
    rows = filters.contains_filter(articles, spec.query, spec.category, spec.source)
    return rows.agg(F.count("*").alias("total"))
