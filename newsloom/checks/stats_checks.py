"""Counts, facets, registry joins and update runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..operators import quality, registry, stats, updates
from ..sources import driver_views as views
from ..sources import export
from .scan_checks import distinct_articles
from .sql_parts import ART, FEEDS, LABELLED, LOGS


def _a(spark, sf):
    return views.articles(spark, sf)


def article_count_by_feed(spark, sf):
    return stats.article_count_by_feed(_a(spark, sf), "src3")


def feeds_active(spark, sf):
    return registry.list_feeds(views.feeds(spark, sf)).select("key", "name", "url", "category", "active")


def feed_by_key(spark, sf):
    from ..operators.filters import lookup
    return lookup(views.feeds(spark, sf), "key", "src7").select("key", "name", "category")


def feeds_with_counts(spark, sf):
    return registry.with_article_counts(views.feeds(spark, sf), _a(spark, sf)).select(
        "key", "name", "active", "article_count")


def feed_quality(spark, sf):
    """Sources and page addresses as candidate feeds, some of them broken."""
    pages = views.pages(spark, sf)
    rows = pages.select(
        F.expr("CASE WHEN page_id % 11 = 0 THEN '' ELSE concat('page', page_id) END").alias("key"),
        F.expr("CASE WHEN page_id % 7 = 0 THEN NULL ELSE url END").alias("name"),
        F.expr("CASE WHEN page_id % 5 = 0 THEN substr(url, 6) ELSE url END").alias("url"),
        F.expr("substr(html, 1, cast(page_id % 3 AS int))").alias("category"),
        F.expr("CASE WHEN page_id % 2 = 0 THEN false END").alias("active"), "page_id")
    checked = quality.check_feeds(rows)
    return checked.select("page_id", "active", F.array_join("reasons", ",").alias("reasons"))


def _changes(spark, sf):
    """Change table for feeds: one row per user group of the events, some keys are new."""
    return views.table(spark, sf, "events").groupBy(
        F.expr("concat('src', cast(user_id % 25 AS string))").alias("key")).agg(
        F.expr("concat('Renamed ', cast(count(*) AS string))").alias("name"),
        F.expr("concat('https://new.example.org/', cast(max(event_id) AS string))").alias("url"),
        F.min("event_type").alias("category"),
        F.expr("max(event_id) % 2 = 0").alias("active"))


def feed_upsert(spark, sf):
    return registry.upsert(views.feeds(spark, sf), _changes(spark, sf), "key",
                           ["name", "url", "category", "active"])


def article_upsert(spark, sf):
    """Articles meet the labelled rows: title and category change where an id exists."""
    base = distinct_articles(spark, sf).select("article_id", "title", "category").filter("category <> 'es'")
    new = (distinct_articles(spark, sf).filter("doc_id % 2 = 0")
           .select("article_id", F.concat(F.lit("new "), "title").alias("title"),
                   F.concat(F.lit("new "), "category").alias("category")))
    return registry.upsert(base, new, "article_id", ["title", "category"])


def feed_create(spark, sf):
    return registry.create(views.feeds(spark, sf), _changes(spark, sf), "key").select(
        "key", "name", "accepted", "reason")


def feed_patch(spark, sf):
    patches = _changes(spark, sf).select(
        "key", F.expr("CASE WHEN active THEN name ELSE '' END").alias("name"),
        F.lit(None).cast("string").alias("url"), F.expr("CASE WHEN active THEN false END").alias("active"))
    return registry.patch(views.feeds(spark, sf), patches, "key", ["name", "url", "active"])


def feed_toggle(spark, sf):
    keys = views.logs(spark, sf).filter("error_message = 'code 3'").select("feed_key")
    return registry.toggle(views.feeds(spark, sf), keys, "key").select("key", "active")


def feed_rename(spark, sf):
    """Inactive feeds get a new key; their articles follow."""
    feeds = views.feeds(spark, sf)
    renames = feeds.filter("NOT active").select("key", F.concat(F.lit("old-"), "key").alias("new_key"))
    out = registry.rename_keys(feeds, _a(spark, sf), renames)
    return out["articles"].select("doc_id", "feed_key")


def cascade_delete(spark, sf):
    feeds = views.feeds(spark, sf)
    keys = feeds.filter("NOT active").select("key")
    return registry.cascade_delete(keys, feeds, _a(spark, sf))["articles"].select("doc_id", "feed_key")


def cascade_delete_counts(spark, sf):
    feeds = views.feeds(spark, sf)
    return registry.cascade_delete(feeds.filter("NOT active").select("key"), feeds, _a(spark, sf))["deleted"]


def _results(spark, sf):
    """The latest run of every feed in the form of a run result."""
    latest = updates.latest_status(views.logs(spark, sf))
    return latest.select(
        F.concat(F.lit("Feed "), "feed_key").alias("feed_name"), F.col("last_fetch_status").alias("status"),
        F.col("last_fetch_error").alias("error_message"), F.col("last_articles_count").alias("articles_added"),
        F.col("last_articles_count").alias("articles_indexed"))


def all_run_results(spark, sf):
    return views.logs(spark, sf).select(
        F.concat(F.lit("Feed "), "feed_key").alias("feed_name"), "status", "error_message",
        F.col("articles_new").alias("articles_added"), F.col("articles_found").alias("articles_indexed"))


def log_life_cycle(spark, sf):
    """Every log row as a running and, unless it failed with code 0, a closing event."""
    logs = views.logs(spark, sf)
    start = logs.select(F.col("log_id").alias("run_id"), "feed_key", F.lit(0).alias("event_seq"), "started_at",
                        F.lit("running").alias("status"), F.lit(None).cast("int").alias("articles_new"))
    end = (logs.filter("error_message IS NULL OR error_message <> 'code 0'")
           .select(F.col("log_id").alias("run_id"), "feed_key", F.lit(1).alias("event_seq"), "started_at",
                   "status", "articles_new"))
    return updates.fold_events(start.unionByName(end)).select("run_id", "feed_key", "status", "articles_new")


def recent_activity(spark, sf):
    feeds = updates.apply_status(views.feeds(spark, sf), updates.latest_status(views.logs(spark, sf)))
    return updates.recent_activity(feeds).select("key", "last_fetched_at", "last_fetch_status")


def fetched_feeds(spark, sf):
    status = updates.latest_status(views.logs(spark, sf).filter("articles_found > 30"))
    return updates.fetched_feeds(updates.apply_status(views.feeds(spark, sf), status)).select(
        "key", "last_articles_count")


def fetched_feeds_gap(spark, sf):
    """Some feeds have never been fetched: they are not listed."""
    status = updates.latest_status(views.logs(spark, sf).filter("feed_key NOT IN ('src3', 'src7', 'src12')"))
    return updates.fetched_feeds(updates.apply_status(views.feeds(spark, sf), status)).select("key", "last_articles_count")


def _renames(spark, sf):
    """Renames of every kind: to a new key, to one that is taken, two to one key, twice, of no feed, to nothing."""
    feeds = views.feeds(spark, sf)
    to = F.expr("""CASE key WHEN 'src0' THEN 'zero' WHEN 'src1' THEN 'src2' WHEN 'src4' THEN 'both' WHEN 'src5' THEN 'both'
                   WHEN 'src6' THEN '' WHEN 'src7' THEN 'b7' WHEN 'src8' THEN 'src8' END""")
    named = feeds.select("key", to.alias("new_key")).filter("new_key IS NOT NULL")
    return (named.unionByName(named.filter("key = 'src7'").withColumn("new_key", F.lit("a7")))
            .unionByName(named.filter("key = 'src0'").select(F.lit("absent").alias("key"), F.lit("there").alias("new_key"))))


def feed_rename_taken(spark, sf):
    """Keys after renames of which most are refused: every key is there once."""
    out = registry.rename_keys(views.feeds(spark, sf), _a(spark, sf), _renames(spark, sf))
    counted = out["articles"].groupBy(F.col("feed_key").alias("key")).agg(F.count("*").alias("articles"))
    return out["feeds"].groupBy("key").agg(F.count("*").alias("feeds")).join(counted, "key")


def feed_rename_rejected(spark, sf):
    return registry.rename_keys(views.feeds(spark, sf), _a(spark, sf), _renames(spark, sf))["rejected"]


def feeds_json(spark, sf):
    """Feeds in their public form, read back."""
    feeds = views.feeds(spark, sf)
    feeds = updates.apply_status(feeds, updates.latest_status(views.logs(spark, sf)))
    for f in schemas.FEEDS.fields:
        if f.name not in feeds.columns:
            feeds = feeds.withColumn(f.name, F.lit(None).cast(f.dataType))
    parsed = F.from_json("json", "id string, name string, url string, category string, active boolean, last_fetch_status string, "
                                 "last_articles_count int, last_fetched_at string, feed_title string")
    return export.feeds_json(feeds).select("id", parsed.alias("j"), F.col("json").contains('"feed_title":null').alias("has_nulls")).select(
        "id", F.col("j.id").alias("inner_id"), "j.name", "j.active", "j.last_fetch_status", "j.last_articles_count", "j.last_fetched_at", "has_nulls")


def logs_json(spark, sf):
    """Log rows in their public form, read back."""
    logs = views.logs(spark, sf).withColumn("run_id", F.col("log_id").cast("string"))
    for f in schemas.UPDATE_LOGS.fields:
        if f.name not in logs.columns:
            logs = logs.withColumn(f.name, F.lit(None).cast(f.dataType))
    parsed = F.from_json("json", "id string, feed_key string, started_at string, status string, articles_new int, error_message string")
    return export.logs_json(logs).select(F.col("id").cast("long").alias("log_id"), parsed.alias("j")).select(
        "log_id", "j.feed_key", "j.started_at", "j.status", "j.articles_new", "j.error_message")


QUERIES = {
    "fetched_feeds_gap": fetched_feeds_gap, "feed_rename_taken": feed_rename_taken, "feed_rename_rejected": feed_rename_rejected,
    "feeds_json": feeds_json, "logs_json": logs_json,
    "article_count": lambda s, p: stats.article_count(_a(s, p)),
    "article_count_by_feed": article_count_by_feed,
    "categories": lambda s, p: stats.distinct_values(_a(s, p), "category"),
    "sources": lambda s, p: stats.distinct_values(_a(s, p), "source"),
    "articles_by_category": lambda s, p: stats.articles_per(_a(s, p), "category"),
    "articles_by_source": lambda s, p: stats.articles_per(_a(s, p), "source"),
    "feed_totals": lambda s, p: stats.feed_totals(views.feeds(s, p), _a(s, p)),
    "search_metadata": lambda s, p: stats.search_metadata(_a(s, p)),
    "database_stats": lambda s, p: stats.database_stats(views.feeds(s, p), _a(s, p), views.logs(s, p)),
    "null_counts": lambda s, p: stats.null_counts(views.logs(s, p)),
    "label_distribution": lambda s, p: stats.label_distribution(views.labelled(s, p)),
    "feeds_active": feeds_active, "feed_by_key": feed_by_key, "feeds_with_counts": feeds_with_counts,
    "feed_quality": feed_quality, "feed_upsert": feed_upsert, "article_upsert": article_upsert,
    "feed_create": feed_create, "feed_patch": feed_patch, "feed_toggle": feed_toggle,
    "feed_rename": feed_rename, "cascade_delete": cascade_delete,
    "cascade_delete_counts": cascade_delete_counts,
    "feed_status_latest": lambda s, p: updates.latest_status(views.logs(s, p)),
    "log_life_cycle": log_life_cycle,
    "run_summary": lambda s, p: updates.run_summary(all_run_results(s, p)),
    "failed_feeds": lambda s, p: updates.failed_feeds(_results(s, p)),
    "failed_runs": lambda s, p: updates.failed_feeds(all_run_results(s, p)),
    "recent_logs": lambda s, p: updates.recent_logs(views.logs(s, p)).select("log_id", "feed_key", "started_at", "status"),
    "recent_logs_of_feed": lambda s, p: updates.recent_logs(views.logs(s, p), "src4", 25).select("log_id", "started_at"),
    "recent_activity": recent_activity, "fetched_feeds": fetched_feeds,
}

_CHANGES = """ch AS (
  SELECT concat('src', CAST(user_id % 25 AS VARCHAR)) AS key, concat('Renamed ', CAST(count(*) AS VARCHAR)) AS name,
         concat('https://new.example.org/', CAST(max(event_id) AS VARCHAR)) AS url, min(event_type) AS category,
         max(event_id) % 2 = 0 AS active
  FROM events GROUP BY 1)"""

_LATEST = """latest AS (
  SELECT feed_key, started_at AS last_fetched_at, status AS last_fetch_status, error_message AS last_fetch_error,
         CASE WHEN status = 'success' THEN articles_new ELSE 0 END AS last_articles_count
  FROM (SELECT *, row_number() OVER (PARTITION BY feed_key ORDER BY started_at DESC, log_id DESC) AS rn FROM {src})
  WHERE rn = 1)"""

_FEED_REASONS = """concat_ws(',',
  CASE WHEN coalesce(length(key), 0) = 0 THEN 'key_missing' END,
  CASE WHEN coalesce(length(name), 0) = 0 THEN 'name_missing' END,
  CASE WHEN NOT coalesce(regexp_matches(url, '(?i)^(https?|ftps?)://[^\\s/?#]+\\.[^\\s/?#]+([/?#]\\S*)?$'), false) THEN 'url_invalid' END,
  CASE WHEN coalesce(length(category), 0) = 0 THEN 'category_missing' END)"""

_NEW_KEY = "CASE source WHEN 'src0' THEN 'zero' WHEN 'src4' THEN 'both' WHEN 'src7' THEN 'a7' ELSE source END"

ORACLES = {
    "fetched_feeds_gap": f"""WITH {LOGS}, {FEEDS}, {_LATEST.format(src="(SELECT * FROM logs WHERE feed_key NOT IN ('src3', 'src7', 'src12'))")}
        SELECT key, last_articles_count FROM feeds JOIN latest ON key = feed_key""",
    "feed_rename_taken": f"SELECT {_NEW_KEY} AS key, 1 AS feeds, count(*) AS articles FROM documents GROUP BY source",
    "feed_rename_rejected": """SELECT * FROM (VALUES ('src1', 'src2', 'the new key is taken'), ('src5', 'both', 'the new key is taken'),
        ('src6', '', 'no new key'), ('src7', 'b7', 'renamed twice'), ('src8', 'src8', 'the new key is taken'),
        ('absent', 'there', 'no such feed')) AS t(key, new_key, reason)""",
    "feeds_json": f"""WITH {LOGS}, {FEEDS}, {_LATEST.format(src='logs')}
        SELECT key AS id, key AS inner_id, name, active, last_fetch_status, coalesce(last_articles_count, 0) AS last_articles_count,
               strftime(last_fetched_at, '%Y-%m-%dT%H:%M:%S.%f') AS last_fetched_at, TRUE AS has_nulls
        FROM feeds LEFT JOIN latest ON key = feed_key""",
    "logs_json": f"""WITH {LOGS} SELECT log_id, feed_key, strftime(started_at, '%Y-%m-%dT%H:%M:%S.%f') AS started_at, status,
        articles_new, error_message FROM logs""",
    "article_count": "SELECT count(*) AS article_count FROM documents",
    "article_count_by_feed": "SELECT count(*) AS article_count FROM documents WHERE source = 'src3'",
    "categories": "SELECT DISTINCT lang AS category FROM documents WHERE lang <> ''",
    "sources": "SELECT DISTINCT source FROM documents WHERE source <> ''",
    "articles_by_category": "SELECT lang AS category, count(*) AS article_count FROM documents GROUP BY lang",
    "articles_by_source": "SELECT source, count(*) AS article_count FROM documents GROUP BY source",
    "feed_totals": f"""WITH {FEEDS} SELECT
        (SELECT count(*) FROM feeds) AS total_feeds, (SELECT count(*) FROM feeds WHERE active) AS active_feeds,
        (SELECT count(*) FROM feeds WHERE NOT active) AS inactive_feeds, count(*) AS total_articles,
        count(DISTINCT nullif(lang, '')) AS category_count, count(DISTINCT nullif(source, '')) AS source_count
        FROM documents""",
    "search_metadata": """SELECT 'category' AS kind, lang AS value, count(*) AS article_count FROM documents
        WHERE lang <> '' GROUP BY lang
        UNION ALL SELECT 'source', source, count(*) FROM documents WHERE source <> '' GROUP BY source
        UNION ALL SELECT 'total', '', count(*) FROM documents""",
    "database_stats": f"""WITH {FEEDS} SELECT 'feeds_count' AS name, count(*) AS value FROM feeds
        UNION ALL SELECT 'articles_count', count(*) FROM documents
        UNION ALL SELECT 'update_logs_count', count(*) FROM events
        UNION ALL SELECT 'active_feeds', count(*) FROM feeds WHERE active""",
    "null_counts": f"WITH {LOGS} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS nulls FROM logs" for c in
        ("log_id", "feed_key", "started_at", "status", "articles_found", "articles_new", "error_message")),
    "label_distribution": f"""WITH {LABELLED} SELECT label, count(*) AS n,
        round(count(*) * 100.0 / (SELECT CAST(count(*) AS DOUBLE) FROM labelled), 4) AS percent
        FROM labelled GROUP BY label""",
    "feeds_active": f"WITH {FEEDS} SELECT key, name, url, category, active FROM feeds WHERE active",
    "feed_by_key": f"WITH {FEEDS} SELECT key, name, category FROM feeds WHERE key = 'src7'",
    "feeds_with_counts": f"""WITH {FEEDS}, c AS (SELECT source AS key, count(*) AS n FROM documents GROUP BY source)
        SELECT key, name, active, coalesce(n, 0) AS article_count FROM feeds LEFT JOIN c USING (key)""",
    "feed_quality": f"""WITH r AS (SELECT page_id,
        CASE WHEN page_id % 11 = 0 THEN '' ELSE concat('page', page_id) END AS key,
        CASE WHEN page_id % 7 = 0 THEN NULL ELSE url END AS name,
        CASE WHEN page_id % 5 = 0 THEN substr(url, 6) ELSE url END AS url,
        substr(html, 1, CAST(page_id % 3 AS INT)) AS category, page_id % 2 <> 0 AS active FROM pages)
        SELECT page_id, active, {_FEED_REASONS} AS reasons FROM r""",
    "feed_upsert": f"""WITH {FEEDS}, {_CHANGES}
        SELECT coalesce(c.key, f.key) AS key, coalesce(c.name, f.name) AS name, coalesce(c.url, f.url) AS url,
               coalesce(c.category, f.category) AS category, coalesce(c.active, f.active) AS active,
               CASE WHEN f.key IS NULL THEN 'added' WHEN c.key IS NULL THEN 'kept' ELSE 'updated' END AS change
        FROM feeds f FULL OUTER JOIN ch c ON f.key = c.key""",
    "article_upsert": f"""WITH {ART}, b AS (SELECT article_id, title, category FROM art WHERE category <> 'es'),
        c AS (SELECT article_id, concat('new ', title) AS title, concat('new ', category) AS category FROM art WHERE doc_id % 2 = 0)
        SELECT coalesce(c.article_id, b.article_id) AS article_id, coalesce(c.title, b.title) AS title,
               coalesce(c.category, b.category) AS category,
               CASE WHEN b.article_id IS NULL THEN 'added' WHEN c.article_id IS NULL THEN 'kept' ELSE 'updated' END AS change
        FROM b FULL OUTER JOIN c ON b.article_id = c.article_id""",
    "feed_create": f"""WITH {FEEDS}, {_CHANGES}
        SELECT c.key, c.name, f.key IS NULL AS accepted,
               CASE WHEN f.key IS NOT NULL THEN concat('key ''', c.key, ''' already exists') END AS reason
        FROM ch c LEFT JOIN feeds f ON f.key = c.key""",
    "feed_patch": f"""WITH {FEEDS}, {_CHANGES}
        SELECT f.key, CASE WHEN c.active THEN c.name ELSE f.name END AS name, f.url, f.category,
               CASE WHEN c.active THEN false ELSE f.active END AS active
        FROM feeds f LEFT JOIN ch c ON f.key = c.key""",
    "feed_toggle": f"""WITH {FEEDS}, {LOGS}
        SELECT key, CASE WHEN key IN (SELECT feed_key FROM logs WHERE error_message = 'code 3')
                         THEN NOT active ELSE active END AS active FROM feeds""",
    "feed_rename": f"""WITH {FEEDS} SELECT doc_id, CASE WHEN active THEN source ELSE concat('old-', source) END AS feed_key
        FROM documents JOIN feeds ON key = source""",
    "cascade_delete": f"""WITH {FEEDS} SELECT doc_id, source AS feed_key FROM documents
        WHERE source NOT IN (SELECT key FROM feeds WHERE NOT active)""",
    "cascade_delete_counts": f"""WITH {FEEDS} SELECT source AS key, count(*) AS deleted_articles FROM documents
        WHERE source IN (SELECT key FROM feeds WHERE NOT active) GROUP BY source""",
    "feed_status_latest": f"WITH {LOGS}, {_LATEST.format(src='logs')} SELECT * FROM latest",
    "log_life_cycle": f"""WITH {LOGS} SELECT log_id AS run_id, feed_key,
        CASE WHEN coalesce(error_message, '') = 'code 0' THEN 'running' ELSE status END AS status,
        CASE WHEN coalesce(error_message, '') = 'code 0' THEN NULL ELSE articles_new END AS articles_new FROM logs""",
    "run_summary": f"""WITH {LOGS} SELECT count(*) AS total_feeds, count(*) FILTER (status = 'success') AS successful,
        count(*) FILTER (status = 'error') AS failed, CAST(sum(articles_new) AS BIGINT) AS articles_added,
        CAST(sum(articles_found) AS BIGINT) AS articles_indexed FROM logs""",
    "failed_feeds": f"""WITH {LOGS}, {_LATEST.format(src='logs')}
        SELECT concat('Feed ', feed_key) AS feed_name, last_fetch_error AS error_message FROM latest
        WHERE last_fetch_status = 'error'""",
    "failed_runs": f"""WITH {LOGS} SELECT concat('Feed ', feed_key) AS feed_name, error_message FROM logs
        WHERE status = 'error'""",
    "recent_logs": f"""WITH {LOGS} SELECT log_id, feed_key, started_at, status FROM logs
        ORDER BY started_at DESC NULLS LAST, log_id LIMIT 10""",
    "recent_logs_of_feed": f"""WITH {LOGS} SELECT log_id, started_at FROM logs WHERE feed_key = 'src4'
        ORDER BY started_at DESC NULLS LAST, log_id LIMIT 25""",
    "recent_activity": f"""WITH {LOGS}, {FEEDS}, {_LATEST.format(src='logs')}
        SELECT key, last_fetched_at, last_fetch_status FROM feeds JOIN latest ON key = feed_key
        ORDER BY last_fetched_at DESC, key LIMIT 5""",
    "fetched_feeds": f"""WITH {LOGS}, {FEEDS}, {_LATEST.format(src='(SELECT * FROM logs WHERE articles_found > 30)')}
        SELECT key, last_articles_count FROM feeds JOIN latest ON key = feed_key""",
}
