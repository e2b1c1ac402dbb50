import datetime as dt

from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.operators import postings, search, updates
from newsloom.operators.search import SearchSpec
from newsloom.plans import ingest
from newsloom.sources import export, tables
from newsloom.streaming import feed_stream

from test_feeds import rss

T0 = dt.datetime(2024, 5, 1)
LAYOUT = postings.IndexLayout(2, 1)


def item(n, words="word"):
    return (f"<item><title>Title {n}</title><link>http://e.org/{n}</link><description>{words}</description>"
            f"<pubDate>0{n} Jan 2024 00:00:00 GMT</pubDate></item>")


def payloads(spark, *rows):
    return spark.createDataFrame([(k, T0 + dt.timedelta(minutes=m), p) for k, m, p in rows], schemas.FEED_PAYLOADS)


def registry(spark):
    return spark.createDataFrame([("a", "Feed A", "News", True), ("b", "Feed B", "Local", True),
                                  ("off", "Feed Off", "News", False)],
                                 "key string, name string, category string, active boolean")


def stored(spark, store):
    rows = tables.read_batches(spark, store.articles, schemas.ARTICLES).collect()
    return sorted((r.title, r.feed_key, r.ingest_batch) for r in rows)


def test_runs_are_incremental_and_repeatable(spark, tmp_path):
    store = ingest.Store(str(tmp_path), LAYOUT)
    first = payloads(spark, ("a", 0, rss(item(1), item(1), item(2))), ("b", 0, rss(item(2), item(3))),
                     ("off", 0, rss(item(9))), ("gone", 0, rss(item(8))))
    assert ingest.ingest_batch(spark, first, registry(spark), store, 0)["articles_added"] == 3
    second = payloads(spark, ("a", 5, rss(item(1), item(4))), ("b", 5, "<rss><channel>"))
    assert ingest.ingest_batch(spark, second, registry(spark), store, 1)["articles_added"] == 1
    before = stored(spark, store)
    assert [t for t, _, _ in before] == ["Title 1", "Title 2", "Title 3", "Title 4"]
    # the same batch once more: a replay after a failure
    assert ingest.ingest_batch(spark, second, registry(spark), store, 1)["articles_added"] == 1
    assert stored(spark, store) == before

    logs = {(r.feed_key, r.ingest_batch): r for r in ingest.update_logs(spark, store).collect()}
    assert len(logs) == 4
    assert (logs["a", 0].status, logs["a", 0].articles_found, logs["a", 0].articles_new) == ("success", 3, 2)
    assert logs["a", 0].feed_metadata == {"title": "Chan", "description": "Desc", "updated": ""}
    assert (logs["b", 1].status, logs["b", 1].articles_new) == ("error", 0)
    assert logs["b", 1].error_message.startswith("Feed parsing error")
    assert logs["a", 1].completed_at == T0 + dt.timedelta(minutes=5)

    index = postings.load_index(spark, store.index, LAYOUT)
    hits = search.match_all(index, SearchSpec("title"))
    assert hits.count() == 4
    # statistics of two batches add up to those of one build
    arts = tables.read_batches(spark, store.articles, schemas.ARTICLES)
    whole = search.match_all(postings.index_articles(arts), SearchSpec("title"))
    assert sorted(hits.collect()) == sorted(whole.collect())

    merged = ingest.compact(spark, store, str(tmp_path / "merged"), 1)
    assert [t for t, _, _ in stored(spark, merged)] == [t for t, _, _ in before]
    again = search.match_all(postings.load_index(spark, merged.index, LAYOUT), SearchSpec("title"))
    assert sorted(again.collect()) == sorted(whole.collect())
    third = payloads(spark, ("a", 9, rss(item(4), item(5))))
    assert ingest.ingest_batch(spark, third, registry(spark), merged, 2)["articles_added"] == 1

    line = export.logs_json(ingest.update_logs(spark, store)).first().json
    assert '"articles_updated":0' in line


def test_inactive_feed_on_request(spark, tmp_path):
    store = ingest.Store(str(tmp_path), keep_index=False)
    out = ingest.ingest_batch(spark, payloads(spark, ("off", 0, rss(item(9)))), registry(spark), store, 0,
                              include_inactive=True)
    assert out["articles_added"] == 1


def test_results_and_summary(spark, tmp_path):
    store = ingest.Store(str(tmp_path), keep_index=False)
    batch = payloads(spark, ("a", 0, rss(item(1))), ("b", 0, None))
    ingest.ingest_batch(spark, batch, registry(spark), store, 0)
    parsed = ingest.feed_source.parse_payloads(batch)
    rows = ingest.feed_results(parsed, tables.read_batches(spark, store.articles, schemas.ARTICLES), registry(spark))
    s = updates.run_summary(rows).first()
    assert (s.total_feeds, s.successful, s.failed, s.articles_added, s.articles_indexed) == (2, 1, 1, 1, 1)
    bad = updates.failed_feeds(rows).first()
    assert bad.feed_name == "Feed B" and "not well-formed" in bad.error_message


def test_stream_takes_what_landed_and_goes_on(spark, tmp_path):
    landing, store = str(tmp_path / "landing"), ingest.Store(str(tmp_path / "store"), keep_index=False)
    payloads(spark, ("a", 0, rss(item(1), item(2))), ("b", 0, "broken")).write.parquet(landing)

    def run():
        q = feed_stream.start_ingest(spark, landing, registry, store, str(tmp_path / "cp"), once=True)
        q.awaitTermination()
        assert q.exception() is None

    run()
    assert [t for t, _, _ in stored(spark, store)] == ["Title 1", "Title 2"]
    payloads(spark, ("b", 1, rss(item(2), item(3)))).write.mode("append").parquet(landing)
    run()
    assert [t for t, _, _ in stored(spark, store)] == ["Title 1", "Title 2", "Title 3"]
    logs = sorted((r.feed_key, r.status) for r in ingest.update_logs(spark, store).collect())
    assert logs == [("a", "success"), ("b", "error"), ("b", "success")]


def test_windowed_dedupe_stream(spark, tmp_path):
    landing = str(tmp_path / "landing")
    payloads(spark, ("a", 0, rss(item(1), item(1), item(2)))).write.parquet(landing)
    rows = feed_stream.windowed_dedupe(feed_stream.read_landing(spark, landing), registry(spark))
    q = (rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
         .option("path", str(tmp_path / "out")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_json_rows(spark):
    df = spark.createDataFrame([("i", None, T0)], "article_id string, tags array<string>, published timestamp")
    for name in export.ARTICLE_FIELDS:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("timestamp" if name == "created_at" else "string"))
    line = export.articles_json(df).first().json
    assert '"tags":[]' in line and '"published":"2024-05-01T00:00:00.000000+00:00"' in line
    assert '"author":null' in line and line.startswith('{"id":"i"')
