"""What a store keeps beside its articles: ids, counts; and small rules of tables."""

import time

import pytest
from pyspark.sql import functions as F

from newsloom.functions.html import read_page
from newsloom.operators import features, known_ids, metrics, registry, splits
from newsloom.plans import rollups, snapshots, training
from newsloom.sources import tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def ids(spark, numbers):
    return spark.createDataFrame([(f"{i:032x}",) for i in numbers], "article_id string")


def test_known_ids(spark, tmp_path):
    path = str(tmp_path / "ids")
    assert not known_ids.exists(spark, path)
    known_ids.write_ids(ids(spark, range(0, 300)), path, 0)
    known_ids.write_ids(ids(spark, range(300, 500)), path, 1)
    known_ids.write_ids(ids(spark, range(300, 400)), path, 1)  # a replay with fewer
    new = ids(spark, range(200, 1000, 3)).withColumn("x", F.lit(1))
    for before, stored in ((None, set(range(400))), (1, set(range(300))), (0, set())):
        got = {int(r.article_id, 16) for r in known_ids.not_known(new, path, before).collect()}
        assert got == set(range(200, 1000, 3)) - stored
    assert known_ids.may_be_known(ids(spark, range(5000, 6000)), path).count() < 20
    held = {int(r.article_id, 16): r.ingest_batch for r in known_ids.may_be_known(ids(spark, [7, 350]), path).collect()}
    assert held == {7: 0, 350: 1}


def test_history_is_not_read_whole(spark, tmp_path):
    path = str(tmp_path / "ids")
    for batch in range(3):
        known_ids.write_ids(ids(spark, range(1000 * batch, 1000 * batch + 200)), path, batch)
    text = plan(known_ids.not_known(ids(spark, [5, 99999]), path))
    assert "dynamicpruning" in text.lower() and "articles" not in text


def test_rollups_follow_all_changes(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = [("a", "n", "A")] * 3 + [("a", None, "A")] + [("b", "n", "B")] * 2 + [("c", "", "C")]
    articles = spark.createDataFrame(rows, "feed_key string, category string, source string")
    rollups.write(rollups.of_articles(articles), path, 0)
    rollups.write(rollups.of_articles(articles.filter("feed_key = 'b'")), path, 1)
    kept = rollups.read(spark, path)
    assert rollups.article_count(kept).first().article_count == 9
    assert {r.category: r.article_count for r in rollups.articles_per(kept, "category").collect()} == {"n": 7, None: 1, "": 1}
    rollups.write(rollups.without_feeds(kept, spark.createDataFrame([("a",)], "key string")), path, 2)
    rollups.write(rollups.with_new_keys(rollups.read(spark, path), spark.createDataFrame([("b", "z")], "key string, new_key string")), path, 3)
    after = rollups.read(spark, path)
    assert sorted(tuple(r) for r in after.collect()) == [("c", "", "C", 1), ("z", "n", "B", 4)]
    assert [r.source for r in rollups.distinct_values(after, "source").collect()] == ["B", "C"]
    left = spark.createDataFrame([("z", "n", "B")], articles.schema)
    rollups.write(rollups.difference(rollups.of_articles(left), after), path, 4)
    assert [tuple(r) for r in rollups.read(spark, path).collect()] == [("z", "n", "B", 1)]
    feeds = spark.createDataFrame([("z", True), ("q", False)], "key string, active boolean")
    assert tuple(rollups.feed_totals(feeds, rollups.read(spark, path)).first()) == (2, 1, 1, 1, 1, 1)


def test_renames_keep_keys_unique(spark):
    feeds = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "key string")
    articles = spark.createDataFrame([("a", 1), ("b", 2), ("d", 3)], "feed_key string, n int")
    asked = [("a", "b"), ("b", "x"), ("c", "x"), ("d", "y"), ("d", "z"), ("d", "y"), ("q", "w"), (None, "v"), ("c", None)]
    renames = spark.createDataFrame(asked, "key string, new_key string")
    out = registry.rename_keys(feeds, articles, renames, articles)
    assert sorted(r.key for r in out["feeds"].collect()) == ["a", "c", "x", "y"]
    assert sorted((r.feed_key, r.n) for r in out["articles"].collect()) == [("a", 1), ("x", 2), ("y", 3)]
    assert sorted(map(str, ((r.key, r.new_key, r.reason) for r in out["rejected"].collect()))) == sorted(map(str, [
        ("a", "b", "the new key is taken"), ("c", "x", "the new key is taken"), ("d", "z", "renamed twice"),
        ("q", "w", "no such feed"), (None, "v", "no such feed"), ("c", None, "no new key")]))


@pytest.mark.parametrize("size", [0, 1, 2, 3, 4, 5, 9])
def test_sample_of_odd_ids(spark, size):
    rows = [(None, "a"), (None, "b"), (1, "c"), (1, "d"), (1, "d")]
    df = spark.createDataFrame(rows, "doc_id long, x string")
    got = [tuple(r) for r in splits.seeded_sample(df, "doc_id", size).collect()]
    assert len(got) == min(size, 5) and all(got.count(r) <= rows.count(r) for r in got)
    assert sorted(got, key=str) == sorted((tuple(r) for r in splits.seeded_sample(df.repartition(4), "doc_id", size).collect()), key=str)


def test_open_paragraphs_cost_their_own_length():
    start = time.perf_counter()
    title, text = read_page("<title>T</title>" + "".join(f"<p>piece {k} of text" for k in range(16_000)))
    assert time.perf_counter() - start < 2 and len(text) < 1_000_000
    assert title == "T" and text.startswith("piece 0 of text piece 1 of text") and text.endswith("piece 15999 of text")
    assert read_page("a<p>b<div>c<p>d</p>e</div>f</p>g<p>h<script>i</script></p>")[1] == "bc d ef h"
    assert read_page("<p>one</p><p>two")[1] == "one two" and read_page("no paragraph")[1] == ""


def test_restore_rolls_back(spark, tmp_path, monkeypatch):
    root, a, b = str(tmp_path / "snap"), str(tmp_path / "a"), str(tmp_path / "b")
    snapshots.take({"a": spark.range(5), "b": spark.range(6)}, root, "s1")
    for path in (a, b):
        tables.publish(spark.range(1), path, "v1")
    real, calls = tables.point_at, []

    def failing(session, path, version):
        calls.append(path)
        if len(calls) == 2:
            raise OSError("no room")
        real(session, path, version)

    monkeypatch.setattr(tables, "point_at", failing)
    assert not snapshots.restore(spark, root, "s1", {"a": a, "b": b}, "safe")
    assert [tables.read_current(spark, p, spark.range(1).schema).count() for p in (a, b)] == [1, 1]


def test_home_changes_all_tables_at_once(spark, tmp_path):
    root, home = str(tmp_path / "snap"), str(tmp_path / "home")
    snapshots.publish_home({"a": spark.range(5), "b": spark.range(6)}, home, "v1")
    cat = snapshots.take({n: snapshots.read_home(spark, home, n) for n in "ab"}, root, "s1")
    assert all(r.bytes > 0 for r in cat.collect())
    snapshots.publish_home({"a": spark.range(1), "b": spark.range(1)}, home, "v2")
    spark.range(1).write.mode("append").parquet(f"{root}/s1/b")  # damage
    assert not snapshots.restore_home(spark, root, "s1", home, ["a", "b"], "x")
    assert snapshots.read_home(spark, home, "a").count() == 1
    snapshots.take({"a": spark.range(3), "b": spark.range(4)}, root, "s2")
    assert snapshots.restore_home(spark, root, "s2", home, ["a", "b"], "y")
    assert [snapshots.read_home(spark, home, n).count() for n in "ab"] == [3, 4]
    assert not snapshots.restore_home(spark, root, "s2", home, ["a", "c"], "z")


def test_folds_side_by_side_equal_one_after_the_other(spark):
    words = "good fine nice calm bad vile rude cruel common plain".split()
    rows = []
    for i in range(80):
        own = words[:4] if i % 2 else words[4:8]
        rows.append((i, " ".join([own[(i * k) % 4] for k in range(1, 6)] + [words[8 + i % 2], f"rare{i % 11}"]), i % 2, i % 4))
    training_rows = spark.createDataFrame(rows, "doc_id long, processed_text string, label int, fold int")
    classifier = features.CredibilityClassifier(max_features=40, max_iter=20)
    want = []
    for fold in range(4):
        model = classifier.fit(training_rows.filter(F.col("fold") != fold))
        want.append(metrics.accuracy(training.predict(model, training_rows.filter(F.col("fold") == fold))).first().accuracy)
        terms, size = classifier.fold_vocabularies(training_rows, 4)[fold]
        assert size == 60 and [r.term for r in terms] == model.stages[3].vocabulary
    assert training.fold_scores(classifier, training_rows, 4) == want
