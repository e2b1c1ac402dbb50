"""Feed update runs: life cycle, status and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def active_payloads(payloads: DataFrame, feeds: DataFrame, include_inactive: bool = False) -> DataFrame:
    """Payloads of registered feeds; inactive ones are skipped unless asked for."""
    chosen = feeds if include_inactive else feeds.filter("active")
    return payloads.join(chosen.select(F.col("key").alias("feed_key")), "feed_key", "left_semi")


def fold_events(events: DataFrame, key: str = "run_id", order: str = "event_seq") -> DataFrame:
    """Current row of every run from its appended events.

    A run has a 'running' event and later a completed one; the latest wins, a run
    that never completed stays 'running'.  The latest is an aggregate, so events are
    folded in the map tasks.
    """
    others = [c for c in events.columns if c != key]
    return (events.groupBy(key)
            .agg(F.max_by(F.struct(*others), F.struct(order, *[
                c for c in others if c != order and not dict(events.dtypes)[c].startswith("map")
            ])).alias("row"))
            .select(key, "row.*").select(*events.columns))


def latest_status(logs: DataFrame, id_column: str = "log_id") -> DataFrame:
    """Last fetch of every feed; the last writer wins.

    ``last_articles_count`` is the number of new articles, not of found ones.
    """
    row = F.struct(F.col("started_at").alias("last_fetched_at"),
                   F.col("status").alias("last_fetch_status"),
                   F.col("error_message").alias("last_fetch_error"),
                   F.when(F.col("status") == "success", F.col("articles_new")).otherwise(0)
                   .alias("last_articles_count"))
    return (logs.groupBy("feed_key")
            .agg(F.max_by(row, F.struct("started_at", id_column)).alias("row"))
            .select("feed_key", "row.*"))


def latest_metadata(logs: DataFrame) -> DataFrame:
    """Title, description and time of change that a feed last told, from its successful runs.

    A run that tells none of one leaves what an earlier run told.
    """
    def last(name):
        value = F.nullif(F.col("feed_metadata")[name], F.lit(""))
        told = F.when((F.col("status") == "success") & value.isNotNull(), F.struct("started_at", value.alias("value")))
        return F.max(told)["value"].alias(f"feed_{name}")

    return logs.groupBy("feed_key").agg(last("title"), last("description"), last("updated"))


def apply_status(feeds: DataFrame, status: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Feed rows with their derived columns in place of the ones they had.

    A feed without a run keeps its status columns if the table has them, else gets nulls; with
    ``metadata`` (see :func:`latest_metadata`) told values replace stored ones, others stay.
    """
    derived = [c for c in status.columns if c != "feed_key"]
    fresh = status.select(F.col("feed_key").alias("_key"), F.lit(True).alias("_run"), *[F.col(c).alias(f"_new_{c}") for c in derived])
    out = feeds.join(fresh, feeds["key"] == F.col("_key"), "left")
    for name in derived:
        value = F.col(f"_new_{name}")
        if name in feeds.columns:
            value = F.when(F.col("_run"), value).otherwise(F.col(name)).cast(feeds.schema[name].dataType)
        out = out.withColumn(name, F.coalesce(value, F.lit(0)) if name == "last_articles_count" else value)
    out = out.select(*feeds.columns, *[c for c in derived if c not in feeds.columns])
    if metadata is None:
        return out
    names = [c for c in metadata.columns if c != "feed_key"]
    told = metadata.select(F.col("feed_key").alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in names])
    joined = out.join(told, F.col("key") == F.col("_key"), "left")
    for name in names:
        stored = F.col(name).cast("string") if name in out.columns else F.lit(None).cast("string")
        joined = joined.withColumn(name, F.coalesce(f"_new_{name}", stored))
    return joined.select(*out.columns, *[c for c in names if c not in out.columns])


def run_results(logs: DataFrame) -> DataFrame:
    """Rows of the stored log under the names of a run's results."""
    return logs.select("feed_key", "feed_name", "status", F.col("articles_found").alias("articles_count"),
                       F.col("articles_new").alias("articles_added"), "articles_indexed", "error_message")


def run_summary(results: DataFrame) -> DataFrame:
    """One row: feeds that worked and failed, articles added and indexed."""
    return results.agg(
        F.count("*").alias("total_feeds"),
        F.count_if(F.col("status") == "success").alias("successful"),
        F.count_if(F.col("status") == "error").alias("failed"),
        F.coalesce(F.sum("articles_added"), F.lit(0)).alias("articles_added"),
        F.coalesce(F.sum("articles_indexed"), F.lit(0)).alias("articles_indexed"))


def failed_feeds(results: DataFrame) -> DataFrame:
    return results.filter("status = 'error'").select("feed_name", "error_message")


def fetched_feeds(feeds: DataFrame) -> DataFrame:
    return feeds.filter(F.col("last_fetched_at").isNotNull())


def recent_logs(logs: DataFrame, feed_key: str | None = None, limit: int = 10,
                id_column: str = "log_id") -> DataFrame:
    rows = logs.filter(F.col("feed_key") == feed_key) if feed_key else logs
    return rows.orderBy(F.col("started_at").desc_nulls_last(), F.col(id_column)).limit(limit)


def recent_activity(feeds: DataFrame, limit: int = 5) -> DataFrame:
    return fetched_feeds(feeds).orderBy(F.col("last_fetched_at").desc(), F.col("key")).limit(limit)
