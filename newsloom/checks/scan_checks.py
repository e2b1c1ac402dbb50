"""Scans, look-ups, filters, orders, pages, identity, export, dedupe."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.ids import article_id
from ..operators import dedupe, filters, quality, retention
from ..plans import snapshots
from ..sources import driver_views as views
from ..sources import export, tables
from ..session import scratch_path
from .sql_parts import ART, FEEDS, LOGS, RAW


def distinct_articles(spark, sf):
    return dedupe.first_per_article(views.articles(spark, sf), ("published", "link", "doc_id"))


def article_scan(spark, sf):
    return views.articles(spark, sf).select("article_id", "doc_id", "title", "link", "published",
                                            "source", "category", "author")


def article_ids(spark, sf):
    a = views.articles(spark, sf)
    return a.select("doc_id", article_id("title", "link").alias("article_id"))


def distinct_articles_query(spark, sf):
    return distinct_articles(spark, sf).select("article_id", "doc_id", "title", "source")


def new_articles(spark, sf):
    """German and French rows are stored already; what is new among all the others?"""
    a = views.articles(spark, sf)
    stored = a.filter("category IN ('de', 'fr')")
    batch = dedupe.first_per_article(a, ("published", "link", "doc_id"))
    return dedupe.not_stored(batch, stored).select("article_id", "doc_id", "source")


def search_contains(spark, sf):
    return filters.contains_filter(views.articles(spark, sf), "thing").select("doc_id", "article_id")


def search_contains_wildcard(spark, sf):
    return filters.contains_filter(views.articles(spark, sf), "th_n%ea").select("doc_id")


def search_contains_escaped(spark, sf):
    return filters.contains_filter(views.articles(spark, sf), "%%%", escape=True).select("doc_id")


def search_filtered(spark, sf):
    return filters.contains_filter(views.articles(spark, sf), "ION", category="E", source="rc1").select(
        "doc_id", "category", "source")


def search_page(spark, sf):
    rows = filters.contains_filter(distinct_articles(spark, sf), "tion")
    page = filters.page_of(rows, filters.article_order("date"), page=2, per_page=20)
    return page.select("article_id", "published", "title")


def search_page_total(spark, sf):
    return filters.contains_filter(distinct_articles(spark, sf), "tion").agg(F.count("*").alias("total"))


def sorted_by_title(spark, sf):
    rows = distinct_articles(spark, sf)
    return filters.page_of(rows, filters.article_order("title"), 1, 50).select("article_id", "title")


def sorted_by_created(spark, sf):
    rows = distinct_articles(spark, sf)
    return filters.page_of(rows, filters.article_order("relevance"), 3, 30).select("article_id", "created_at")


def keyword_filter(spark, sf):
    return filters.keyword_filter(views.articles(spark, sf), "category", "EN").select("doc_id", "category")


def keyword_filter_tokens(spark, sf):
    a = views.articles(spark, sf).withColumn("category", F.concat_ws(" ", "category", "source"))
    return filters.keyword_filter(a, "category", "SRC3", "token").select("doc_id")


def tag_filter(spark, sf):
    return filters.tag_filter(views.articles(spark, sf), " Src7 ").select("doc_id")


def tags_round_trip(spark, sf):
    a = views.articles(spark, sf).withColumn("joined", F.concat(tx.join_tags("tags"), F.lit(", ,x ")))
    return a.select("doc_id", F.array_join(tx.split_tags("joined"), "|").alias("tags"))


def article_by_id(spark, sf):
    """The article stored for the longest text, looked up by its id."""
    a = distinct_articles(spark, sf)
    wanted = (views.articles(spark, sf)
              .agg(F.max_by("article_id", F.struct(F.length("content"), "doc_id")).alias("i")).scalar())
    return a.filter(F.col("article_id") == wanted).limit(1).select("article_id", "doc_id", "title")


def recent_articles(spark, sf):
    return filters.newest(distinct_articles(spark, sf), "created_at", 10, "article_id").select(
        "article_id", "created_at")


def article_quality(spark, sf):
    checked = quality.check_articles(views.articles(spark, sf))
    return checked.select("doc_id", F.array_join("reasons", ",").alias("reasons"))



def article_json_fields(spark, sf):
    a = views.articles(spark, sf)
    js = export.to_json_rows(a.withColumn("key", F.col("doc_id").cast("string")), "key", export.ARTICLE_FIELDS)
    parsed = F.from_json("json", "id string, title string, link string, published string, tags array<string>,"
                                 " created_at string, feed_key string")
    return js.select(F.col("id").cast("long").alias("doc_id"), parsed.alias("j")).select(
        "doc_id", "j.title", "j.link", "j.published", F.array_join("j.tags", "|").alias("tags"),
        "j.created_at", "j.feed_key")


def previews(spark, sf):
    a = views.articles(spark, sf)
    return a.select("doc_id", tx.preview("content", 500).alias("p500"), tx.preview("content", 200).alias("p200"),
                    tx.preview("summary", 300).alias("p300"), tx.preview("title", 100).alias("p100"),
                    tx.preview("source", 30).alias("p30"), tx.preview("content", 100, True).alias("demo"))


def retention_logs(spark, sf):
    kept = retention.with_expiry(views.logs(spark, sf), "started_at", "log_id",
                                 F.expr("TIMESTAMP_NTZ'2024-01-20 00:00:00'"), 10, "feed_key")
    return kept.select("log_id", "feed_key", "expired")


def retention_null_key(spark, sf):
    """Rows without a key are a group of their own and expire as others do."""
    logs = views.logs(spark, sf).withColumn("feed_key", F.when(F.col("feed_key") != "src3", F.col("feed_key")))
    kept = retention.with_expiry(logs, "started_at", "log_id", F.expr("TIMESTAMP_NTZ'2024-01-20 00:00:00'"), 10, "feed_key")
    return kept.select("log_id", "feed_key", "expired")


def retention_table(spark, sf):
    return retention.retain(views.logs(spark, sf), "started_at", "log_id",
                            F.expr("TIMESTAMP_NTZ'2024-01-25 00:00:00'"), 10).select("log_id")


def snapshot(spark, sf):
    """Snapshot of two tables; figures come from the written copies."""
    root = scratch_path(spark, "snapshot")
    cat = snapshots.take({"articles": views.articles(spark, sf), "logs": views.logs(spark, sf)}, root, "s1")
    return cat.select("table_name", "row_count", "compression")


def snapshot_restore(spark, sf):
    """Publish, snapshot, lose rows, restore: the rows that are current afterwards."""
    root = scratch_path(spark, "restore")
    logs = views.logs(spark, sf)
    tables.publish(logs, f"{root}/logs", "v1")
    snapshots.take({"logs": spark.read.parquet(f"{root}/logs/v1")}, f"{root}/snap", "s1")
    tables.publish(logs.filter("status = 'error'"), f"{root}/logs", "v2")
    if not snapshots.restore(spark, f"{root}/snap", "s1", {"logs": f"{root}/logs"}, "before"):
        raise RuntimeError("restore failed")
    return tables.read_current(spark, f"{root}/logs", logs.schema).select("log_id", "feed_key", "status")


def snapshot_bytes(spark, sf):
    """The catalogue knows the size of each copy; a compressed one is smaller."""
    root, named = scratch_path(spark, "snapshot"), {"articles": views.articles(spark, sf), "logs": views.logs(spark, sf)}
    small = snapshots.take(named, root, "s1").select("table_name", "bytes")
    large = snapshots.take(named, root, "s2", compress=False).select("table_name", F.col("bytes").alias("plain"))
    return small.join(large, "table_name").select("table_name", (F.col("bytes") > 0).alias("sized"),
                                                  (F.col("bytes") < F.col("plain")).alias("smaller"))


def restore_two_tables(spark, sf):
    """Two tables of one home go back together, by one row of one table."""
    home, root = scratch_path(spark, "home"), scratch_path(spark, "snapshots")
    logs, arts = views.logs(spark, sf), views.articles(spark, sf).select("article_id", "doc_id")
    snapshots.publish_home({"logs": logs, "articles": arts}, home, "v1")
    snapshots.take({n: snapshots.read_home(spark, home, n) for n in ("logs", "articles")}, root, "s1")
    snapshots.publish_home({"logs": logs.limit(1), "articles": arts.limit(1)}, home, "v2")
    if not snapshots.restore_home(spark, root, "s1", home, ["logs", "articles"], "before"):
        raise RuntimeError("restore failed")
    return (snapshots.read_home(spark, home, "logs").agg(F.count("*").alias("n"), F.sum("log_id").alias("total"))
            .select(F.lit("logs").alias("name"), "n", "total").unionByName(
                snapshots.read_home(spark, home, "articles").agg(F.count("*").alias("n"), F.sum("doc_id").alias("total"))
                .select(F.lit("articles").alias("name"), "n", "total")))


QUERIES = {
    "snapshot_bytes": snapshot_bytes, "restore_two_tables": restore_two_tables,
    "article_scan": article_scan, "article_ids": article_ids, "distinct_articles": distinct_articles_query,
    "new_articles": new_articles, "search_contains": search_contains,
    "search_contains_wildcard": search_contains_wildcard,
    "search_contains_escaped": search_contains_escaped, "search_filtered": search_filtered,
    "search_page": search_page, "search_page_total": search_page_total,
    "sorted_by_title": sorted_by_title, "sorted_by_created": sorted_by_created,
    "keyword_filter": keyword_filter, "keyword_filter_tokens": keyword_filter_tokens,
    "tag_filter": tag_filter, "tags_round_trip": tags_round_trip, "article_by_id": article_by_id,
    "recent_articles": recent_articles, "article_quality": article_quality,
    "article_json_fields": article_json_fields, "previews": previews, "retention": retention_logs,
    "retention_null_key": retention_null_key,
    "retention_table": retention_table, "snapshot": snapshot, "snapshot_restore": snapshot_restore,
}

_CONTAINS = "(title ILIKE '{0}' OR summary ILIKE '{0}' OR content ILIKE '{0}')"
_TITLE_REASON = """concat_ws(',',
  CASE WHEN NOT (length(title) BETWEEN 1 AND 500) THEN 'title_length' END,
  CASE WHEN NOT regexp_matches(link, '(?i)^(https?|ftps?)://[^\\s/?#]+\\.[^\\s/?#]+([/?#]\\S*)?$') THEN 'link_invalid' END,
  CASE WHEN source IS NULL THEN 'source_missing' END,
  CASE WHEN category IS NULL THEN 'category_missing' END)"""


def _preview(text, n):
    return f"CASE WHEN length({text}) > {n} THEN concat(substr({text}, 1, {n}), '...') ELSE {text} END"


_KEY = "concat('src', CAST(user_id % 20 AS VARCHAR)) AS feed_key"
_NULL_KEY = "nullif(concat('src', CAST(user_id % 20 AS VARCHAR)), 'src3') AS feed_key"

ORACLES = {
    "snapshot_bytes": "SELECT unnest(['articles', 'logs']) AS table_name, TRUE AS sized, TRUE AS smaller",
    "restore_two_tables": """SELECT 'logs' AS name, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events
        UNION ALL SELECT 'articles', count(*), CAST(sum(doc_id) AS BIGINT) FROM documents""",
    "article_scan": f"WITH {RAW} SELECT article_id, doc_id, title, link, published, source, category, author FROM raw",
    "article_ids": f"WITH {RAW} SELECT doc_id, md5(concat(title, link)) AS article_id FROM raw",
    "distinct_articles": f"WITH {ART} SELECT article_id, doc_id, title, source FROM art",
    "new_articles": f"""WITH {ART} SELECT article_id, doc_id, source FROM art WHERE article_id NOT IN
        (SELECT article_id FROM raw WHERE category IN ('de', 'fr'))""",
    "search_contains": f"WITH {RAW} SELECT doc_id, article_id FROM raw WHERE " + _CONTAINS.format("%thing%"),
    "search_contains_wildcard": f"WITH {RAW} SELECT doc_id FROM raw WHERE " + _CONTAINS.format("%th_n%ea%"),
    "search_contains_escaped": f"""WITH {RAW} SELECT doc_id FROM raw WHERE contains(title, '%%%')
        OR contains(summary, '%%%') OR contains(content, '%%%')""",
    "search_filtered": f"WITH {RAW} SELECT doc_id, category, source FROM raw WHERE "
                       + _CONTAINS.format("%ION%") + " AND category ILIKE '%E%' AND source ILIKE '%rc1%'",
    "search_page": f"WITH {ART} SELECT article_id, published, title FROM art WHERE "
                   + _CONTAINS.format("%tion%")
                   + " ORDER BY published DESC NULLS LAST, article_id LIMIT 20 OFFSET 20",
    "search_page_total": f"WITH {ART} SELECT count(*) AS total FROM art WHERE " + _CONTAINS.format("%tion%"),
    "sorted_by_title": f"WITH {ART} SELECT article_id, title FROM art ORDER BY title NULLS LAST, article_id LIMIT 50",
    "sorted_by_created": f"""WITH {ART} SELECT article_id, created_at FROM art
        ORDER BY created_at DESC NULLS LAST, article_id LIMIT 30 OFFSET 60""",
    "keyword_filter": f"WITH {RAW} SELECT doc_id, category FROM raw WHERE lower(category) = 'en'",
    "keyword_filter_tokens": f"WITH {RAW} SELECT doc_id FROM raw WHERE lower(source) = 'src3' OR lower(category) = 'src3'",
    "tag_filter": f"WITH {RAW} SELECT doc_id FROM raw WHERE list_contains(list_transform(tags, lambda t: lower(t)), 'src7')",
    "tags_round_trip": f"WITH {RAW} SELECT doc_id, concat(category, '|', source, '|x') AS tags FROM raw",
    "article_by_id": f"""WITH {ART} SELECT article_id, doc_id, title FROM art WHERE article_id =
        (SELECT article_id FROM raw ORDER BY length(content) DESC, doc_id DESC LIMIT 1)""",
    "recent_articles": f"""WITH {ART} SELECT article_id, created_at FROM art
        ORDER BY created_at DESC NULLS LAST, article_id LIMIT 10""",
    "article_quality": f"WITH {RAW} SELECT doc_id, {_TITLE_REASON} AS reasons FROM raw",
    "article_json_fields": f"""WITH {RAW} SELECT doc_id, title, link,
        strftime(published, '%Y-%m-%dT%H:%M:%S.%f') AS published, array_to_string(tags, '|') AS tags,
        strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') AS created_at, feed_key FROM raw""",
    "previews": f"""WITH {RAW} SELECT doc_id, {_preview('content', 500)} AS p500, {_preview('content', 200)} AS p200,
        {_preview('summary', 300)} AS p300, {_preview('title', 100)} AS p100, {_preview('source', 30)} AS p30,
        concat(substr(content, 1, 100), '...') AS demo FROM raw""",
    "retention": f"""WITH {LOGS}, r AS (SELECT *, row_number() OVER
          (PARTITION BY feed_key ORDER BY started_at DESC NULLS LAST, log_id DESC) AS rn FROM logs)
        SELECT log_id, feed_key, rn > 10 AND started_at < TIMESTAMP '2024-01-20 00:00:00' AS expired FROM r""",
    "retention_null_key": f"""WITH {LOGS.replace(_KEY, _NULL_KEY)}, r AS (SELECT *, row_number() OVER
          (PARTITION BY feed_key ORDER BY started_at DESC NULLS LAST, log_id DESC) AS rn FROM logs)
        SELECT log_id, feed_key, rn > 10 AND started_at < TIMESTAMP '2024-01-20 00:00:00' AS expired FROM r""",
    "retention_table": f"""WITH {LOGS}, r AS (SELECT *, row_number() OVER
          (ORDER BY started_at DESC NULLS LAST, log_id DESC) AS rn FROM logs)
        SELECT log_id FROM r WHERE NOT (rn > 10 AND started_at < TIMESTAMP '2024-01-25 00:00:00')""",
    "snapshot": """SELECT 'articles' AS table_name, count(*) AS row_count, 'zstd' AS compression FROM documents
        UNION ALL SELECT 'logs', count(*), 'zstd' FROM events""",
    "snapshot_restore": f"WITH {LOGS} SELECT log_id, feed_key, status FROM logs",
}
