"""What keeps large tables from ending in a few tasks, in many shuffles or in large Python objects."""

import zlib

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from newsloom.functions import slices, term_places
from newsloom.operators import contains, dedupe, postings
from newsloom.operators.postings import IndexLayout
from newsloom.sources import tables


def _articles(spark, n=40):
    return spark.range(n).selectExpr(
        "md5(cast(id as string)) AS article_id", "concat('alpha word', id) AS title", "'beta gamma' AS summary",
        "concat('alpha beta delta', id) AS content", "TIMESTAMP'2024-01-01' AS published", "'en' AS category", "'s' AS source")


def _files(spark, path, folder):
    names = spark.read.parquet(path).filter(folder).select(F.input_file_name().alias("f")).distinct()
    return names.count()


def test_one_folder_is_written_by_many_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        postings.write_index(_articles(spark), str(tmp_path / "i"), fields=("content",), stem=False, layout=IndexLayout(1, 1))
        contains.write_grams(_articles(spark), str(tmp_path / "g"), layout=contains.GramLayout(1, 1, 1))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert _files(spark, str(tmp_path / "i/postings"), "term = 'alpha'") > 1
    assert _files(spark, str(tmp_path / "g/lists"), "gram = 'alp'") > 1
    assert _files(spark, str(tmp_path / "g/articles"), "id_bucket = 0") > 1


def test_full_rows_are_shuffled_once(spark):
    twice = _articles(spark).unionByName(_articles(spark))
    first = dedupe.first_per_article(twice, ("published",))
    assert first._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(article_id") == 1
    assert first.count() == 40


def test_texts_are_cut_by_bytes():
    texts = pa.array(["a" * 30, None, "b" * 30, "c" * 500, "", "d"])
    parts = [p.to_pylist() for p in slices.by_bytes(texts, 64)]
    assert [x for p in parts for x in p] == texts.to_pylist()
    assert len(parts) > 1 and all(sum(len(x or "") for x in p[:-1]) <= 64 for p in parts)
    assert list(slices.by_bytes(pa.array([], pa.string()))) == []


def test_blocks_of_tokens_do_not_change_postings(spark, monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array([["b", "a", "b"], [], None, ["a"]], pa.list_(pa.string()))], names=["t"])
    monkeypatch.setattr(term_places, "BLOCK_TOKENS", 2)
    made = term_places.Postings([False], None, lambda field, tf, length: tf)
    found = []
    for block in term_places.blocks(batch, [0]):
        own = made.of_block([block.column(0)])
        found += zip(own["term"].to_pylist(), own["tf"].tolist(), own["positions"].to_pylist(), own["field_length"].tolist())
    assert sorted(found) == [("a", 1, [0], 1), ("a", 1, [1], 3), ("b", 2, [0, 2], 3)]


def test_dead_postings_go_by_broadcast_and_by_join(spark, tmp_path):
    from newsloom.plans.ingest import _alive
    rows = _articles(spark).select("article_id").withColumn("ingest_batch", F.lit(0).cast("long"))
    ids, left = rows.select("article_id"), rows.select("article_id").limit(25)
    left = spark.createDataFrame(left.collect(), "article_id string")
    past = F.col("ingest_batch") <= 0
    broadcast, joined = [_alive(ids, left, past, most)(rows) for most in (500_000, 0)]
    assert "BroadcastHashJoin" in broadcast._jdf.queryExecution().executedPlan().toString()
    assert sorted(broadcast.collect()) == sorted(joined.collect()) == sorted(left.collect())


def test_articles_are_dealt_by_the_bytes_of_their_files(spark, tmp_path, monkeypatch):
    from newsloom import schemas
    from newsloom.plans import ingest
    path = str(tmp_path / "a")
    rows = _articles(spark, 400).selectExpr("*", *[f"cast(null AS {f.dataType.simpleString()}) AS {f.name}" for f in schemas.ARTICLES.fields
                                                   if f.name not in _articles(spark).columns])
    for batch in (0, 1):
        tables.write_batch(rows.filter(f"length(title) % 2 = {batch}"), path, batch)
    every, some = tables.read_batches(spark, path, schemas.ARTICLES), ingest.batch_rows(spark, path, 1)
    assert sorted(map(repr, some.collect())) == sorted(map(repr, every.filter("ingest_batch = 1").select(some.columns).collect()))
    assert 0 < tables.input_bytes(some) < tables.input_bytes(every) and tables.input_bytes(spark.range(3)) == 0
    assert postings.dealt_articles(every).rdd.getNumPartitions() == every.rdd.getNumPartitions()
    monkeypatch.setattr(postings, "LEAST_BYTES", 1)
    monkeypatch.setattr(postings, "TASK_BYTES", -(-tables.input_bytes(every) // 9))
    assert postings.dealt_articles(every).rdd.getNumPartitions() == 9


def test_postings_are_the_same_with_and_without_a_shuffle(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "a")
    _articles(spark, 60).write.parquet(path)
    monkeypatch.setattr(postings, "LEAST_BYTES", 1)
    found = []
    for i, folders in enumerate((postings.OWN_FOLDERS, 0)):
        monkeypatch.setattr(postings, "OWN_FOLDERS", folders)
        own = str(tmp_path / f"i{i}")
        assert postings.write_index(spark.read.parquet(path), own, fields=("title", "content"), layout=IndexLayout(3, 1)) == 60
        found.append([sorted(map(repr, read(spark, own).collect())) for read in (
            postings.read_postings, postings.read_term_stats, postings.read_terms, postings.read_term_grams)])
    assert found[0] == found[1] and found[0][0]


def test_batches_are_written_with_zstd(spark, tmp_path):
    tables.write_batch(spark.range(9).coalesce(1), str(tmp_path), 0)
    file, = (tmp_path / "ingest_batch=0").glob("*.parquet")
    assert pq.read_metadata(file).row_group(0).column(0).compression == "ZSTD"


def test_articles_meet_the_keys_of_feeds_without_a_shuffle(spark, tmp_path):
    from newsloom.operators import registry
    keys = spark.range(40).selectExpr("cast(id % 3 AS string) AS key").distinct()
    path = str(tmp_path / "a")
    _articles(spark).withColumn("feed_key", F.col("source")).write.parquet(path)
    left = registry.without_keys(spark.read.parquet(path), tables.kept(keys, "keys"), "feed_key")
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and left.count() == 40


def test_retention_meets_the_last_kept_rows_without_a_shuffle_of_articles(spark, tmp_path):
    from newsloom.operators import retention
    path = str(tmp_path / "a")
    _articles(spark).selectExpr("*", "source AS feed_key").write.parquet(path)
    rows, asked = spark.read.parquet(path), ("published", "article_id", F.current_timestamp(), 7, "feed_key")
    last = tables.kept(retention.last_kept(rows, "published", "article_id", 7, "feed_key"), "last")
    kept = retention.retain(rows, *asked, last=last)
    assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(kept.collect()) == sorted(retention.retain(rows, *asked).collect()) and kept.count() == 7


def test_statistics_of_an_unchanged_index_are_copied(spark, tmp_path, monkeypatch):
    from newsloom.plans import ingest
    from newsloom import schemas
    old = ingest.Store(str(tmp_path / "old"), IndexLayout(3, 1), ("title", "source"))
    rows = _articles(spark).selectExpr("*", *[f"cast(null AS {f.dataType.simpleString()}) AS {f.name}" for f in schemas.ARTICLES.fields
                                              if f.name not in _articles(spark).columns])
    tables.write_batch(rows.select([f.name for f in schemas.ARTICLES.fields]), old.articles, 0)
    tables.write_batch(spark.createDataFrame([], schemas.UPDATE_LOGS), old.logs, 0)
    postings.write_index(rows, old.index, 0, old.index_fields, layout=old.layout)
    monkeypatch.setattr(postings, "write_statistics", lambda *_: 1 / 0)
    new = ingest.rewrite(spark, old, str(tmp_path / "new"), 4, articles=lambda a: a.withColumn("feed_key", F.lit("other")))
    for read in (postings.read_postings, postings.read_term_stats, postings.read_terms, postings.read_term_grams, postings.read_field_stats):
        before, after = [sorted(map(repr, read(spark, s.index).drop("ingest_batch").collect())) for s in (old, new)]
        assert before == after and before


def test_tasks_of_term_grams_follow_the_bytes_of_terms(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "TERM_BYTES", 1 << 10)
    rows = _articles(spark, 300).withColumn("content", F.concat(F.lit("x"), F.md5("article_id")))
    postings.write_index(rows, str(tmp_path), fields=("content",), stem=False, layout=IndexLayout(1, 1))
    assert len(list((tmp_path / "term_grams/ingest_batch=0/gram_bucket=0").glob("*.parquet"))) > 4
    held = postings.read_term_grams(spark, str(tmp_path)).select("term").distinct()
    assert sorted(held.collect()) == sorted(postings.read_term_stats(spark, str(tmp_path)).select("term").collect())


def test_blocks_are_handed_over_in_the_order_of_a_written_index(spark):
    fields, buckets = ("title", "summary", "content"), 3
    batch = pa.RecordBatch.from_arrays(
        [pa.array(x, pa.list_(pa.string())) for x in (
            [["zeta", "alpha"], None, ["é"]], [["alpha", "b"], ["\U0001F600", "￮"], []],
            [["walking", "walks", "alpha"], ["alpha", "é", "alpha"], ["b", "zeta"]])], names=list(fields))
    made = term_places.Postings([True, True, True], None, lambda field, tf, length: tf)
    own = made.of_block(batch.columns)
    order = term_places.sorted_rows(own, list(fields), buckets)
    assert sorted(order) == list(range(len(own["row"])))
    keys = [(fields[own["field"][i]], zlib.crc32(own["term"][i].as_py().encode()) % buckets, own["term"][i].as_py().encode(),
             own["impact"][i]) for i in order.tolist()]
    assert keys == sorted(keys)
    empty = made.of_block([pa.array([[], None], pa.list_(pa.string()))] * 3)
    assert len(term_places.sorted_rows(empty, list(fields), buckets)) == 0


def test_ordered_postings_are_the_same_rows(spark):
    articles, layout = _articles(spark), IndexLayout(3, 1)
    plain, ordered = (postings.build_postings(articles.coalesce(1), layout=layout, in_order=x) for x in (False, True))
    rows = [r.asDict() for r in ordered.collect()]
    assert sorted(map(repr, rows)) == sorted(repr(r.asDict()) for r in plain.collect()) and rows
    keys = [(r["field"], r["term_bucket"], r["term"], r["impact"]) for r in rows]
    assert keys == sorted(keys)
