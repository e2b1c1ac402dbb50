import datetime as dt

from pyspark.sql import functions as F

from newsloom.operators import quality, registry, retention, splits, stats, updates

T0, T1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
FEEDS = "key string, name string, url string, category string, active boolean, created_at timestamp, updated_at timestamp"


def feeds(spark):
    return spark.createDataFrame([(k, f"N{k}", f"http://{k}.org", "c", k != "b", T0, T0) for k in "abc"], FEEDS)


def arts(spark):
    return spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b"), ("3b", "zz")], "article_id string, feed_key string")


def test_upsert_counts_and_times(spark):
    new = spark.createDataFrame([("b", "NewB", True), ("d", "NewD", False)], "key string, name string, active boolean")
    out = {r.key: r for r in registry.upsert(feeds(spark), new, "key", ["name", "active"], F.lit(T1)).collect()}
    assert {k: r.change for k, r in out.items()} == {"a": "kept", "b": "updated", "c": "kept", "d": "added"}
    assert (out["b"].name, out["b"].active, out["b"].url, out["b"].created_at, out["b"].updated_at) == (
        "NewB", True, "http://b.org", T0, T1)
    assert (out["d"].created_at, out["a"].updated_at, out["d"].url) == (T1, T0, None)


def test_create_rejects_known_and_doubled_keys(spark):
    new = spark.createDataFrame([("a", "x"), ("d", "y"), ("d", "x")], "key string, name string")
    out = {r.key: r for r in registry.create(feeds(spark), new, "key").collect()}
    assert not out["a"].accepted and "already exists" in out["a"].reason
    assert out["d"].accepted and out["d"].name == "x" and out["d"].reason is None


def test_patch_and_replace(spark):
    p = spark.createDataFrame([("a", "", None), ("b", "B!", True)], "key string, name string, active boolean")
    out = {r.key: r for r in registry.patch(feeds(spark), p, "key", ["name", "active"], F.lit(T1)).collect()}
    assert (out["a"].name, out["a"].active, out["a"].updated_at) == ("Na", True, T1)
    assert (out["b"].name, out["b"].active, out["c"].updated_at) == ("B!", True, T0)
    raw = {r.key: r for r in registry.patch(feeds(spark), p, "key", ["name"], blank_is_missing=False).collect()}
    assert raw["a"].name == ""


def test_rename_moves_articles(spark):
    ren = spark.createDataFrame([("a", "A2")], "key string, new_key string")
    out = registry.rename_keys(feeds(spark), arts(spark), ren)
    assert sorted(r.key for r in out["feeds"].collect()) == ["A2", "b", "c"]
    assert sorted((r.article_id, r.feed_key) for r in out["articles"].collect()) == [
        ("1", "A2"), ("2", "A2"), ("3", "b"), ("3b", "zz")]


def test_cascade_delete_with_postings(spark):
    keys = spark.createDataFrame([("a",), ("c",), ("nope",)], "key string")
    post = spark.createDataFrame([("1", "t"), ("3", "t"), ("2", "u")], "article_id string, term string")
    out = registry.cascade_delete(keys, feeds(spark), arts(spark), post)
    assert [r.key for r in out["feeds"].collect()] == ["b"]
    assert {r.article_id for r in out["articles"].collect()} == {"3", "3b"}
    assert {(r.key, r.deleted_articles) for r in out["deleted"].collect()} == {("a", 2), ("c", 0)}
    assert [r.article_id for r in out["postings"].collect()] == ["3"]


def test_toggle_lists_counts(spark):
    keys = spark.createDataFrame([("a",), ("a",), ("b",)], "key string")
    assert {r.key: r.active for r in registry.toggle(feeds(spark), keys, "key").collect()} == {
        "a": False, "b": True, "c": True}
    assert [r.key for r in registry.list_feeds(feeds(spark)).collect()] == ["a", "c"]
    assert [r.key for r in registry.list_feeds(feeds(spark), False).collect()] == ["a", "b", "c"]
    assert {r.key: r.article_count for r in registry.with_article_counts(feeds(spark), arts(spark)).collect()} == {
        "a": 2, "b": 1, "c": 0}


def test_quality(spark):
    rows = spark.createDataFrame([("k", "n", "https://e.org/x", "c", None), ("", None, "e.org", "c", False),
                                  ("k", "n", "ftp://h", "", True)],
                                 "key string, name string, url string, category string, active boolean")
    got = [(r.active, r.reasons) for r in quality.check_feeds(rows).collect()]
    assert got == [(True, []), (False, ["key_missing", "name_missing", "url_invalid"]),
                   (True, ["url_invalid", "category_missing"])]
    assert quality.good(quality.check_feeds(rows)).count() == 1 and quality.bad(quality.check_feeds(rows)).count() == 2
    texts = spark.createDataFrame([(None, "x"), ("t", "  \n"), ("t", None)], "title string, content string")
    assert [(r.title, r.error is None) for r in quality.check_texts(texts).collect()] == [
        ("", True), ("t", False), ("t", False)]


def test_empty_tables_give_zeros(spark):
    none = feeds(spark).filter(F.lit(False))
    a = spark.createDataFrame([], "source string, category string")
    row = stats.feed_totals(none, a).first()
    assert tuple(row) == (0, 0, 0, 0, 0, 0)
    assert updates.run_summary(spark.createDataFrame(
        [], "status string, articles_added int, articles_indexed int")).first().articles_added == 0


def brute_retention(rows, keep, cutoff):
    kept, by_key = set(), {}
    for r in sorted(rows, key=lambda r: (r[2], r[0]), reverse=True):
        by_key.setdefault(r[1], []).append(r)
    for group in by_key.values():
        kept |= {r[0] for i, r in enumerate(group) if i < keep or r[2] >= cutoff}
    return kept


def test_retention_with_a_hot_key(spark):
    rows = [(i, "hot" if i % 3 else f"k{i % 7}", T0 + dt.timedelta(hours=i // 2)) for i in range(400)]
    rows += [(1000 + i, "exact", T0) for i in range(5)] + [(2000, "lone", T0)]
    df = spark.createDataFrame(rows, "id int, k string, ts timestamp").repartition(5)
    cutoff = T0 + dt.timedelta(hours=100)
    got = retention.retain(df, "ts", "id", F.lit(cutoff), 5, "k")
    assert {r.id for r in got.collect()} == brute_retention(rows, 5, cutoff)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    whole = retention.retain(df, "ts", "id", F.lit(cutoff), 7)
    assert {r.id for r in whole.collect()} == brute_retention([(i, 0, t) for i, _, t in rows], 7, cutoff)


def test_split_folds_and_sample(spark):
    df = spark.range(997).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    a = {r.doc_id: r.is_test for r in splits.stratified_split(df, "doc_id").collect()}
    b = {r.doc_id: r.is_test for r in splits.stratified_split(df.repartition(7), "doc_id").collect()}
    assert a == b and len(a) == 997
    assert sum(v for k, v in a.items() if k % 10 == 0) == 20 and sum(v for k, v in a.items() if k % 10) == 179
    folds = splits.stratified_folds(df, "doc_id", 4).groupBy("label", "fold").count().collect()
    for label in (0, 1):
        sizes = [r["count"] for r in folds if r.label == label]
        assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1
    for size in (1, 100, 996, 997, 5000):
        assert splits.seeded_sample(df, "doc_id", size).count() == min(size, 997)
    one = {r.doc_id for r in splits.seeded_sample(df, "doc_id", 50).collect()}
    assert one == {r.doc_id for r in splits.seeded_sample(df.repartition(3), "doc_id", 50).collect()}
    assert one != {r.doc_id for r in splits.seeded_sample(df, "doc_id", 50, seed=1).collect()}
