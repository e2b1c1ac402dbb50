"""Maintenance of keyed tables (feeds, and articles where it applies).

All changes are bulk: a change table goes in, the next version of the table comes
out, and :mod:`newsloom.sources.tables` publishes it.  The joins carry no hints; the
change side is usually small and is broadcast when its measured size allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def list_feeds(feeds: DataFrame, active_only: bool = True) -> DataFrame:
    rows = feeds.filter("active") if active_only else feeds
    return rows.orderBy("name", "key")


def with_article_counts(feeds: DataFrame, articles: DataFrame) -> DataFrame:
    """All feeds, active or not, with their number of articles (0 when none).

    Articles are counted per feed before the join, so a feed that owns a third of
    them arrives as one row.
    """
    counts = articles.groupBy(F.col("feed_key").alias("key")).agg(F.count("*").alias("n"))
    return (feeds.join(counts, "key", "left")
            .withColumn("article_count", F.coalesce("n", F.lit(0))).drop("n"))


def without_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(F.col(keys.columns[0]).alias(key)), key, "left_anti")


def cascade_delete(keys: DataFrame, feeds: DataFrame, articles: DataFrame,
                   postings: DataFrame | None = None) -> dict[str, DataFrame]:
    """Delete feeds with their articles and, when given, the postings of these articles.

    Returns the remaining tables and ``deleted``, the number of articles removed per
    deleted feed.
    """
    keys = keys.select(F.col(keys.columns[0]).alias("key")).distinct()
    doomed = articles.join(keys.withColumnRenamed("key", "feed_key"), "feed_key", "left_semi")
    gone = doomed.groupBy(F.col("feed_key").alias("key")).agg(F.count("*").alias("n"))
    out = {
        "feeds": without_keys(feeds, keys, "key"),
        "articles": without_keys(articles, keys, "feed_key"),
        "deleted": (feeds.join(keys, "key", "left_semi").select("key").join(gone, "key", "left")
                    .select("key", F.coalesce("n", F.lit(0)).alias("deleted_articles")))}
    if postings is not None:
        # an id that another feed still holds stays searchable
        dead = doomed.select("article_id").join(out["articles"].select("article_id"),
                                                "article_id", "left_anti").distinct()
        out["postings"] = without_keys(postings, dead, "article_id")
    return out


def upsert(base: DataFrame, changes: DataFrame, key: str, columns: list[str],
           now=None) -> DataFrame:
    """Update ``columns`` where the key exists, else insert.

    Adds ``change`` (``added``, ``updated`` or ``kept``) so the counts come from the
    same pass.  ``changes`` has one row per key.
    """
    b = base.withColumn("in_base", F.lit(True))
    c = changes.select(key, *[F.col(x).alias(f"new_{x}") for x in columns], F.lit(True).alias("in_new"))
    joined = b.join(c, key, "full_outer")
    out = []
    for name in base.columns:
        value = F.col(name)
        if name in columns:
            value = F.coalesce(f"new_{name}", name)
        elif name == "updated_at" and now is not None:
            value = F.when(F.col("in_new"), now).otherwise(F.col(name))
        elif name == "created_at" and now is not None:
            value = F.when(F.col("in_base"), F.col(name)).otherwise(now)
        out.append(value.alias(name))
    change = (F.when(F.col("in_base").isNull(), "added")
              .when(F.col("in_new").isNull(), "kept").otherwise("updated"))
    return joined.select(*out, change.alias("change"))


def create(base: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Insert-only: candidates with ``accepted`` and the reason of a rejection.

    A key that exists is rejected; of several candidates with one key the first by
    value is accepted.
    """
    others = [c for c in candidates.columns if c != key]
    first = (candidates.groupBy(key).agg(F.min(F.struct(*others)).alias("row"))
             .select(key, "row.*"))
    known = base.select(key, F.lit(True).alias("known"))
    return (first.join(known, key, "left")
            .withColumn("accepted", F.col("known").isNull())
            .withColumn("reason", F.when(F.col("known"), F.concat(
                F.lit("key '"), F.col(key), F.lit("' already exists"))))
            .drop("known"))


def patch(base: DataFrame, patches: DataFrame, key: str, columns: list[str], now=None,
          blank_is_missing: bool = True) -> DataFrame:
    """Replace only supplied values.

    With ``blank_is_missing`` an empty text is not a value.  ``updated_at`` moves for
    every key that has a patch row.
    """
    def supplied(name):
        value = F.col(f"new_{name}")
        is_text = dict(patches.dtypes)[name] == "string"
        return F.nullif(value, F.lit("")) if blank_is_missing and is_text else value

    p = patches.select(key, *[F.col(x).alias(f"new_{x}") for x in columns], F.lit(True).alias("hit"))
    out = []
    for name in base.columns:
        value = F.col(name)
        if name in columns:
            value = F.coalesce(supplied(name), F.col(name))
        elif name == "updated_at" and now is not None:
            value = F.when(F.col("hit"), now).otherwise(F.col(name))
        out.append(value.alias(name))
    return base.join(p, key, "left").select(*out)


def checked_renames(feeds: DataFrame, renames: DataFrame) -> DataFrame:
    """``(key, new_key, reason)`` of every distinct rename; ``reason`` is null if it is accepted.

    Keys stay unique: a new key that a feed has, or that several renames want, goes to nobody but, of
    the latter, the first by key; a feed is renamed once, to the first new key by value.
    """
    known = feeds.select("key").distinct()
    r = renames.select("key", "new_key").distinct()
    r = (r.join(known.select("key", F.lit(True).alias("is_feed")), "key", "left")
         .join(known.select(F.col("key").alias("new_key"), F.lit(True).alias("taken")), "new_key", "left"))
    refused = (F.when(F.col("is_feed").isNull(), "no such feed")
               .when(F.coalesce(F.col("new_key"), F.lit("")) == "", "no new key")
               .when(F.col("taken"), "the new key is taken"))
    r = r.withColumn("reason", refused)
    open_ = F.col("reason").isNull()
    first = F.min(F.when(open_, F.col("new_key"))).over(Window.partitionBy("key"))
    r = r.withColumn("reason", F.when(open_ & (F.col("new_key") != first), "renamed twice").otherwise(F.col("reason")))
    owner = F.min(F.when(F.col("reason").isNull(), F.col("key"))).over(Window.partitionBy("new_key"))
    return r.select("key", "new_key", F.when(F.col("reason").isNull() & (F.col("key") != owner), "the new key is taken")
                    .otherwise(F.col("reason")).alias("reason"))


def rename_keys(feeds: DataFrame, articles: DataFrame, renames: DataFrame,
                logs: DataFrame | None = None) -> dict[str, DataFrame]:
    """Change feed keys (``key``, ``new_key``) in the registry, the articles and, when given, the logs.

    ``rejected`` has the renames that :func:`checked_renames` refuses; they change nothing.
    """
    checked = checked_renames(feeds, renames)
    r = checked.filter("reason IS NULL").select("key", "new_key")
    out = {"feeds": with_new_keys(feeds, r, "key"), "articles": with_new_keys(articles, r, "feed_key"),
           "rejected": checked.filter("reason IS NOT NULL")}
    return out if logs is None else out | {"logs": with_new_keys(logs, r, "feed_key")}


def with_new_keys(table: DataFrame, accepted: DataFrame, column: str) -> DataFrame:
    """``table`` with the key in ``column`` changed by renames (``key``, ``new_key``) that have been accepted."""
    return (table.join(accepted.withColumnRenamed("key", column), column, "left")
            .withColumn(column, F.coalesce("new_key", column)).select(*table.columns))


def toggle(base: DataFrame, keys: DataFrame, key: str, flag: str = "active") -> DataFrame:
    hit = keys.select(F.col(keys.columns[0]).alias(key)).distinct().withColumn("hit", F.lit(True))
    return (base.join(hit, key, "left")
            .withColumn(flag, F.when(F.col("hit"), ~F.col(flag)).otherwise(F.col(flag)))
            .select(*base.columns))
