"""Maintenance of a store as jobs that write: the next store comes out, the old one stays.

Each job writes articles, logs and index of the new store completely before anything points at it.
``publish`` then names it in one row of one table, so readers see all of its tables change at once.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import registry as feed_registry
from ..operators import retention
from ..sources import tables
from . import rollups
from .ingest import Store, rewrite


def publish(spark: SparkSession, home: str, store: Store) -> None:
    """Make ``store`` the current one of ``home``."""
    tables.point_at(spark, home, store.root)


def current(spark: SparkSession, home: str, like: Store) -> Store | None:
    """The current store of ``home``, with the settings of ``like``."""
    root = tables.current_version(spark, home)
    return None if root is None else replace(like, root=root)


def delete_feeds(spark: SparkSession, store: Store, new_root: str, through_batch: int, feeds: DataFrame,
                 keys: DataFrame) -> tuple[Store, DataFrame]:
    """Feeds, their articles and what the index holds of them go; logs stay.

    Returns the new store and the remaining registry.
    """
    keys = tables.kept(keys.select(F.col(keys.columns[0]).alias("key")).distinct(), "keys")

    def others(articles):
        return feed_registry.without_keys(articles, keys, "feed_key")

    return (rewrite(spark, store, new_root, through_batch, articles=others,
                    counts=lambda before: rollups.without_feeds(before, keys)),
            feed_registry.without_keys(feeds, keys, "key"))


def rename_feeds(spark: SparkSession, store: Store, new_root: str, through_batch: int, feeds: DataFrame,
                 renames: DataFrame) -> tuple[Store, DataFrame]:
    """Feed keys (``key``, ``new_key``) change in the registry, the articles and the logs.

    Renames that would break the uniqueness of keys are refused, see ``registry.checked_renames``.
    """
    accepted = tables.kept(feed_registry.checked_renames(feeds, renames).filter("reason IS NULL").select("key", "new_key"), "renames")

    def renamed(table):
        return feed_registry.with_new_keys(table, accepted, "feed_key")

    return (rewrite(spark, store, new_root, through_batch, articles=renamed, logs=renamed,
                    counts=lambda before: rollups.with_new_keys(before, accepted)),
            feed_registry.with_new_keys(feeds, accepted, "key"))


def retain_articles(spark: SparkSession, store: Store, new_root: str, through_batch: int, cutoff: Column,
                    keep_count: int = 10) -> Store:
    """Of every feed the newest articles stay, and all that are not older than ``cutoff``."""
    def newest(articles):
        last = tables.kept(retention.last_kept(articles, "published", "article_id", keep_count, "feed_key"), "last")
        return retention.retain(articles, "published", "article_id", cutoff, keep_count, "feed_key", last)

    return rewrite(spark, store, new_root, through_batch, articles=newest)


def retain_logs(spark: SparkSession, store: Store, new_root: str, through_batch: int, cutoff: Column,
                keep_count: int = 10) -> Store:
    """Of every feed the newest log events stay, and all that are not older than ``cutoff``."""
    def newest(logs):
        return retention.retain(logs.withColumn("_id", F.concat("run_id", F.lit("/"), "event_seq")), "started_at", "_id",
                                cutoff, keep_count, "feed_key").drop("_id")

    return rewrite(spark, store, new_root, through_batch, logs=newest)
