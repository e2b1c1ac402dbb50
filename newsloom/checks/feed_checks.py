"""Feed payloads, ingest runs and the stream, over payloads made of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..operators import dedupe, known_ids, postings, updates
from ..operators.postings import IndexLayout
from ..plans import ingest, maintenance, rollups
from ..session import scratch_path
from ..sources import driver_views as views
from ..sources import feeds as feed_source
from ..sources import tables
from ..streaming import feed_stream
from .scan_checks import distinct_articles
from .sql_parts import ART, FEEDS


def _entries(spark, sf):
    parsed = feed_source.parse_payloads(views.feed_payloads(spark, sf))
    return dedupe.with_article_id(feed_source.entries_to_articles(parsed, views.feeds(spark, sf)))


def feed_entries(spark, sf):
    """Entries that came through XML and back; times as seconds."""
    return _entries(spark, sf).select(
        "link", "title", "article_id", "author", F.array_join("tags", ",").alias("tags"), "feed_key", "source",
        F.unix_seconds("published").alias("published_seconds"))


def feed_entry_texts(spark, sf):
    squeeze = lambda c: F.md5(F.regexp_replace(c, r"[^a-zA-Z0-9]+", ""))
    return _entries(spark, sf).select("link", squeeze("content").alias("content"),
                                      squeeze("summary").alias("summary"))


def active_feed_payloads(spark, sf):
    chosen = updates.active_payloads(views.feed_payloads(spark, sf), views.feeds(spark, sf))
    return chosen.groupBy("feed_key").agg(F.count("*").alias("payloads"))


def _run(spark, sf, batches=1, keep_index=True, **kwargs):
    """Ingest the payloads in ``batches`` runs, by time of fetching."""
    store = ingest.Store(scratch_path(spark, "ingest"), IndexLayout(4, 1), keep_index=keep_index)
    payloads, registry = views.feed_payloads(spark, sf), views.feeds(spark, sf)
    for i in range(batches):
        part = payloads.filter(F.pmod(F.unix_seconds("fetched_at"), F.lit(batches)) == i)
        ingest.ingest_batch(spark, part, registry, store, i, **kwargs)
    return store


def ingest_articles(spark, sf):
    """All feeds, inactive ones too, in two runs: every text is stored once."""
    store = _run(spark, sf, 2, include_inactive=True)
    return tables.read_batches(spark, store.articles, schemas.ARTICLES).select("article_id", "link")


def feed_run_results(spark, sf):
    """One run over the active feeds: found, added and status per feed, from the log."""
    store = _run(spark, sf)
    return ingest.update_logs(spark, store).select(
        "feed_key", "feed_name", "status", "articles_found", "articles_new", "articles_indexed", "articles_updated",
        "feed_entries_count",
        F.col("feed_metadata")["title"].alias("feed_title"))


def ingest_added(spark, sf):
    store = _run(spark, sf, include_inactive=True)
    return ingest.update_logs(spark, store).agg(F.sum("articles_new").alias("articles_new"),
                                                F.count("*").alias("feeds"))


def stream_ingest(spark, sf):
    """Payloads land as files, the stream takes them one file at a time."""
    landing, checkpoint = scratch_path(spark, "landing"), scratch_path(spark, "stream")
    views.feed_payloads(spark, sf).repartition(2, "fetched_at").write.parquet(landing)
    store = ingest.Store(scratch_path(spark, "store"), IndexLayout(4, 1))
    query = feed_stream.start_ingest(spark, landing, lambda s: views.feeds(s, sf), store, checkpoint, once=True,
                                     max_files=1)
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return tables.read_batches(spark, store.articles, schemas.ARTICLES).select("article_id", "link")


def run_summary_stored(spark, sf):
    """Summary of a run over the active feeds, from its stored log."""
    return updates.run_summary(updates.run_results(ingest.update_logs(spark, _run(spark, sf))))


def feed_status_applied(spark, sf):
    """The registry after a run: status and what the payloads tell; inactive feeds keep what they had."""
    feeds = views.feeds(spark, sf)
    for field in schemas.FEEDS.fields:
        if field.name not in feeds.columns:
            feeds = feeds.withColumn(field.name, F.lit("old title" if field.name == "feed_title" else None).cast(field.dataType))
    done = ingest.refreshed_registry(spark, _run(spark, sf), feeds)
    return done.select("key", "last_fetch_status", "last_articles_count", "feed_title", "feed_description",
                       F.col("last_fetched_at").isNotNull().alias("fetched"))


def feed_bad_payload(spark, sf):
    """One feed's payloads are broken: it ends as an error, the others are stored."""
    store = ingest.Store(scratch_path(spark, "ingest"), IndexLayout(4, 1))
    payloads = views.feed_payloads(spark, sf).withColumn(
        "payload", F.when(F.col("feed_key") == "src1", F.lit("<rss><channel>")).otherwise(F.col("payload")))
    ingest.ingest_batch(spark, payloads, views.feeds(spark, sf), store, 0)
    return ingest.update_logs(spark, store).select("feed_key", "status", "articles_found",
                                                   F.col("error_message").isNotNull().alias("told"))


def replay_emptier(spark, sf):
    """A batch that comes again with some payloads fewer: no article, posting or log row of the others stays."""
    store = ingest.Store(scratch_path(spark, "ingest"), IndexLayout(4, 1))
    payloads, feeds = views.feed_payloads(spark, sf), views.feeds(spark, sf)
    ingest.ingest_batch(spark, payloads, feeds, store, 0)
    ingest.ingest_batch(spark, payloads.filter("feed_key = 'src2'"), feeds, store, 0)
    hits = postings.read_postings(spark, store.index).filter("field = 'source'").select("article_id", "term")
    arts = tables.read_batches(spark, store.articles, schemas.ARTICLES).select("article_id", "feed_key")
    return arts.join(hits, "article_id", "full").select("article_id", "feed_key", F.col("term").alias("indexed_source"))


def _maintained(spark, sf, job):
    store = _run(spark, sf, include_inactive=True)
    return job(store, scratch_path(spark, "maintained"))


def store_delete_feed(spark, sf):
    """What is left after two feeds are deleted: articles, postings, df and number of articles of each source."""
    def job(store, root):
        keys = spark.createDataFrame([("src0",), ("src3",)], "key string")
        return maintenance.delete_feeds(spark, store, root, 0, views.feeds(spark, sf), keys)

    store, feeds = _maintained(spark, sf, job)
    arts = tables.read_batches(spark, store.articles, schemas.ARTICLES).groupBy("source").agg(F.count("*").alias("articles"))
    held = postings.read_postings(spark, store.index).filter("field = 'source'").groupBy("term").agg(F.count("*").alias("postings"))
    df = postings.read_term_stats(spark, store.index).filter("field = 'source'").select("term", "df")
    n = postings.read_field_stats(spark, store.index).filter("field = 'source'").agg(F.sum("n_articles")).scalar()
    return (feeds.select("key", F.col("name").alias("source")).join(arts, "source")
            .join(held.withColumnRenamed("term", "low"), F.col("low") == F.lower("source"))
            .join(df.withColumnRenamed("term", "own"), F.col("own") == F.lower("source"))
            .select("key", "articles", "postings", "df", n.alias("n_articles")))


def store_rename(spark, sf):
    def job(store, root):
        names = spark.createDataFrame([("src1", "first")], "key string, new_key string")
        return maintenance.rename_feeds(spark, store, root, 0, views.feeds(spark, sf), names)

    store, feeds = _maintained(spark, sf, job)
    arts = tables.read_batches(spark, store.articles, schemas.ARTICLES).groupBy("feed_key").agg(F.count("*").alias("articles"))
    logs = ingest.update_logs(spark, store).groupBy("feed_key").agg(F.count("*").alias("logs"))
    return feeds.select(F.col("key").alias("feed_key")).join(arts, "feed_key").join(logs, "feed_key")


def store_retention(spark, sf):
    """Of every feed the five newest articles, and all from a day on."""
    def job(store, root):
        return maintenance.retain_articles(spark, store, root, 0, F.expr("TIMESTAMP'2024-01-01 12:00:00'"), 5)

    store = _maintained(spark, sf, job)
    arts = tables.read_batches(spark, store.articles, schemas.ARTICLES).select("article_id", "feed_key")
    return arts.join(postings.read_ids(spark, store.index).select("article_id"), "article_id", "full").select("article_id", "feed_key")


def _changed_store(spark, sf):
    """A run, then two feeds are deleted, one gets a new key, and old articles expire."""
    store = _run(spark, sf, keep_index=False, include_inactive=True)
    keys = spark.createDataFrame([("src0",), ("src3",)], "key string")
    store, feeds = maintenance.delete_feeds(spark, store, scratch_path(spark, "deleted"), 0, views.feeds(spark, sf), keys)
    names = spark.createDataFrame([("src1", "first"), ("src2", "src4")], "key string, new_key string")
    store, feeds = maintenance.rename_feeds(spark, store, scratch_path(spark, "renamed"), 0, feeds, names)
    return maintenance.retain_articles(spark, store, scratch_path(spark, "retained"), 0,
                                       F.expr("TIMESTAMP'2024-01-01 10:00:00'"), 7), feeds


def rollup_metadata(spark, sf):
    """Facets from kept counts, after all kinds of changes; no article is read for them."""
    store, _ = _changed_store(spark, sf)
    return rollups.search_metadata(rollups.read(spark, store.rollups))


def rollup_feeds(spark, sf):
    """Articles per feed from kept counts, and a count of the articles themselves."""
    store, feeds = _changed_store(spark, sf)
    kept = rollups.feeds_with_counts(feeds, rollups.read(spark, store.rollups)).select("key", "article_count")
    counted = tables.read_batches(spark, store.articles, schemas.ARTICLES).groupBy(F.col("feed_key").alias("key")).agg(
        F.count("*").alias("counted"))
    return kept.join(counted, "key", "left")


def new_articles_filtered(spark, sf):
    """German and French articles are stored in two batches; what is new among all, by filters of their ids."""
    path, arts = scratch_path(spark, "known"), distinct_articles(spark, sf)
    for batch, category in enumerate(("de", "fr")):
        known_ids.write_ids(views.articles(spark, sf).filter(F.col("category") == category).select("article_id").distinct(), path, batch)
    return known_ids.not_known(arts, path).select("article_id", "doc_id", "source")


QUERIES = {
    "rollup_metadata": rollup_metadata, "rollup_feeds": rollup_feeds, "new_articles_filtered": new_articles_filtered,
    "run_summary_stored": run_summary_stored, "feed_status_applied": feed_status_applied,
    "feed_bad_payload": feed_bad_payload, "replay_emptier": replay_emptier, "store_delete_feed": store_delete_feed,
    "store_rename": store_rename, "store_retention": store_retention,
    "feed_entries": feed_entries, "feed_entry_texts": feed_entry_texts,
    "active_feed_payloads": active_feed_payloads, "ingest_articles": ingest_articles,
    "feed_run_results": feed_run_results, "ingest_added": ingest_added, "stream_ingest": stream_ingest,
}

_T = "trim(split_part(text, chr(10), 1))"
_IDS = f"""a AS (SELECT *, md5(concat({_T}, 'https://example.org/', md5(text))) AS article_id,
    concat('https://example.org/', md5(text)) AS link FROM documents)"""
_SQUEEZE = "md5(regexp_replace({0}, '[^a-zA-Z0-9]+', '', 'g'))"

_ACTIVE = "CAST(substr(source, 4) AS INT) % 5 <> 0"
# of the copies of an article the first by publish time, link and name of the feed is stored
_FIRST = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY doc_id, concat('Feed ', source), source) AS rn
    FROM (SELECT doc_id, source, md5(concat(trim(split_part(text, chr(10), 1)), 'https://example.org/', md5(text))) AS article_id
          FROM documents WHERE {where})) WHERE rn = 1"""
_NEW = "SELECT source, count(*) AS n FROM (" + _FIRST + ") GROUP BY source"

_KEPT = f"""f AS ({_FIRST.format(where='TRUE')}), r AS (
      SELECT article_id, source, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS published, lang
      FROM f JOIN (SELECT source, min(lang) AS lang FROM documents GROUP BY source) USING (source) WHERE source NOT IN ('src0', 'src3')),
    p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY published DESC NULLS LAST, article_id DESC) AS place FROM r),
    k AS (SELECT * FROM p WHERE place <= 7 OR published >= TIMESTAMP '2024-01-01 10:00:00')"""

ORACLES = {
    "rollup_metadata": f"""WITH {_KEPT} SELECT 'category' AS kind, lang AS value, count(*) AS article_count FROM k WHERE lang <> '' GROUP BY lang
        UNION ALL SELECT 'source', concat('Feed ', source), count(*) FROM k GROUP BY source UNION ALL SELECT 'total', '', count(*) FROM k""",
    "rollup_feeds": f"""WITH {FEEDS}, {_KEPT}, c AS (SELECT CASE WHEN source = 'src1' THEN 'first' ELSE source END AS key, count(*) AS n
          FROM k GROUP BY source), x AS (SELECT CASE WHEN key = 'src1' THEN 'first' ELSE key END AS key FROM feeds WHERE key NOT IN ('src0', 'src3'))
        SELECT key, coalesce(n, 0) AS article_count, n AS counted FROM x LEFT JOIN c USING (key)""",
    "new_articles_filtered": f"""WITH {ART} SELECT article_id, doc_id, source FROM art WHERE article_id NOT IN
        (SELECT article_id FROM raw WHERE category IN ('de', 'fr'))""",
    "feed_entries": f"""WITH {_IDS} SELECT link, {_T} AS title, article_id,
        concat('Writer ', CAST(length(text) % 97 AS VARCHAR)) AS author, lang AS tags, source AS feed_key,
        concat('Feed ', source) AS source,
        CAST(epoch(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id)) AS BIGINT) AS published_seconds FROM a""",
    "feed_entry_texts": f"""WITH {_IDS} SELECT link, {_SQUEEZE.format('text')} AS content,
        {_SQUEEZE.format('substr(text, 1, 300)')} AS summary FROM a""",
    "active_feed_payloads": f"""WITH {FEEDS} SELECT source AS feed_key, count(DISTINCT doc_id // 400) AS payloads
        FROM documents WHERE source IN (SELECT key FROM feeds WHERE active) GROUP BY source""",
    "ingest_articles": f"WITH {_IDS} SELECT DISTINCT article_id, link FROM a",
    "feed_run_results": f"""WITH {FEEDS} SELECT source AS feed_key, concat('Feed ', source) AS feed_name,
        'success' AS status, CAST(count(*) AS INT) AS articles_found, CAST(coalesce(any_value(n), 0) AS INT) AS articles_new,
        CAST(coalesce(any_value(n), 0) AS INT) AS articles_indexed, 0 AS articles_updated,
        CAST(count(*) AS INT) AS feed_entries_count, source AS feed_title
        FROM documents LEFT JOIN ({_NEW.format(where=_ACTIVE)}) USING (source)
        WHERE {_ACTIVE} GROUP BY source""",
    "run_summary_stored": f"""WITH {FEEDS}, {_IDS} SELECT count(DISTINCT source) AS total_feeds,
        count(DISTINCT source) AS successful, 0 AS failed, count(DISTINCT article_id) AS articles_added,
        count(DISTINCT article_id) AS articles_indexed FROM a WHERE {_ACTIVE}""",
    "feed_status_applied": f"""WITH {FEEDS} SELECT key, CASE WHEN active THEN 'success' END AS last_fetch_status,
        CASE WHEN active THEN coalesce(CAST(n AS INT), 0) ELSE 0 END AS last_articles_count,
        CASE WHEN active THEN key ELSE 'old title' END AS feed_title,
        CASE WHEN active THEN 'landed' END AS feed_description, active AS fetched
        FROM feeds LEFT JOIN ({_NEW.format(where=_ACTIVE)}) x ON x.source = key""",
    "feed_bad_payload": f"""WITH {FEEDS} SELECT source AS feed_key, CASE WHEN source = 'src1' THEN 'error' ELSE 'success' END AS status,
        CASE WHEN source = 'src1' THEN 0 ELSE CAST(count(*) AS INT) END AS articles_found, source = 'src1' AS told
        FROM documents WHERE {_ACTIVE} GROUP BY source""",
    "replay_emptier": f"""WITH {_IDS} SELECT DISTINCT article_id, 'src2' AS feed_key, 'feed src2' AS indexed_source
        FROM a WHERE source = 'src2'""",
    "store_delete_feed": f"""WITH x AS ({_NEW.format(where='TRUE')}), k AS (SELECT * FROM x WHERE source NOT IN ('src0', 'src3'))
        SELECT source AS key, n AS articles, n AS postings, n AS df, CAST((SELECT sum(n) FROM k) AS BIGINT) AS n_articles FROM k""",
    "store_rename": f"""SELECT CASE WHEN source = 'src1' THEN 'first' ELSE source END AS feed_key, n AS articles, 1 AS logs
        FROM ({_NEW.format(where='TRUE')})""",
    "store_retention": f"""WITH f AS ({_FIRST.format(where='TRUE')}), r AS (
          SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS published FROM f),
        p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY published DESC NULLS LAST, article_id DESC) AS place FROM r)
        SELECT article_id, source AS feed_key FROM p WHERE place <= 5 OR published >= TIMESTAMP '2024-01-01 12:00:00'""",
    "ingest_added": f"WITH {_IDS} SELECT count(DISTINCT article_id) AS articles_new, count(DISTINCT source) AS feeds FROM a",
    "stream_ingest": f"""WITH {FEEDS}, {_IDS} SELECT DISTINCT article_id, link FROM a
        WHERE source IN (SELECT key FROM feeds WHERE active)""",
}
