import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from newsloom.plans import corpus, snapshots
from newsloom.session import scratch_path, shared_root
from newsloom.sources import corpus_csv, tables


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.current_version(spark, path) is None
    tables.publish(spark.range(3), path, "v1")
    tables.publish(spark.range(5), path, "v2")
    assert tables.read_current(spark, path, spark.range(1).schema).count() == 5
    tables.point_at(spark, path, "v1")
    assert tables.read_current(spark, path, spark.range(1).schema).count() == 3


def test_batches_replace_themselves(spark, tmp_path):
    path, schema = str(tmp_path / "b"), spark.range(1).schema
    assert tables.read_batches(spark, path, schema).count() == 0
    tables.write_batch(spark.range(3), path, 0)
    tables.write_batch(spark.range(4), path, 1)
    tables.write_batch(spark.range(2), path, 1)
    assert tables.read_batches(spark, path, schema).count() == 5
    assert tables.read_batches(spark, path, schema, before_batch=1).count() == 3


def test_fingerprint(spark):
    df = spark.range(50).withColumn("m", F.create_map(F.lit("a"), F.col("id")))
    first = snapshots.fingerprint(df).first()
    assert first == snapshots.fingerprint(df.repartition(7)).first() and first.row_count == 50
    assert snapshots.fingerprint(df.filter("id <> 3")).first().content_hash != first.content_hash
    assert snapshots.fingerprint(df.filter("id < 0")).first() == (0, 0)


def test_restore_puts_back_and_refuses_damage(spark, tmp_path):
    root, target = str(tmp_path / "snap"), str(tmp_path / "t")
    schema = spark.range(1).schema
    tables.publish(spark.range(10), target, "v1")
    cat = snapshots.take({"t": spark.range(10)}, root, "s1", compress=False)
    assert (cat.first().row_count, cat.first().compression) == (10, "uncompressed")
    tables.publish(spark.range(2), target, "v2")
    # damage: the copy has a row more than the catalogue says
    spark.range(1).write.mode("append").parquet(f"{root}/s1/t")
    assert not snapshots.restore(spark, root, "s1", {"t": target}, "safe1")
    assert tables.read_current(spark, target, schema).count() == 2
    snapshots.take({"t": spark.range(10)}, root, "s2")
    assert snapshots.restore(spark, root, "s2", {"t": target}, "safe2")
    assert tables.read_current(spark, target, schema).count() == 10
    assert spark.read.parquet(f"{root}/safe2/t").count() == 2
    assert not snapshots.restore(spark, root, "unknown", {"t": target}, "safe3")


CSV = '''title,text,label
"A ""quoted"" title","two
lines, and a comma",1
,only text here,0
No text,,1
'''


def test_corpus_csv_and_cache(spark, tmp_path):
    source = tmp_path / "c.csv"
    source.write_text(CSV)
    rows = corpus_csv.read_corpus(spark, str(source)).collect()
    assert [tuple(r) for r in rows] == [('A "quoted" title', "two\nlines, and a comma", 1),
                                        (None, "only text here", 0), ("No text", None, 1)]
    calls = []

    def prepare(df):
        calls.append(1)
        return corpus.prepare(df)

    cache = str(tmp_path / "cache")
    for _ in range(2):
        assert corpus_csv.cached_or_prepare(spark, str(source), cache, prepare).count() == 3
    assert len(calls) == 1
    corpus_csv.cached_or_prepare(spark, str(source), cache, prepare, force=True)
    assert len(calls) == 2
    time.sleep(1.1)
    source.write_text(CSV + "Extra,words here,0\n")
    assert corpus_csv.cached_or_prepare(spark, str(source), cache, prepare).count() == 4
    other = tmp_path / "d.csv"
    other.write_text(CSV)
    corpus_csv.cached_or_prepare(spark, str(other), cache, prepare)
    assert len(calls) == 4
    assert corpus_csv.cache_path("r", "a") != corpus_csv.cache_path("r", "b")


def test_shared_root_follows_the_session(spark):
    assert shared_root(spark) == shared_root(spark)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")

    def session(master, **conf):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k.replace(".", "_"), d)),
                               sparkContext=SimpleNamespace(master=master))

    assert shared_root(session("yarn", spark_checkpoint_dir="/shared/")) == "/shared"
    assert scratch_path(session("yarn", spark_checkpoint_dir="/shared/"), "x").startswith("/shared/x-")
    with pytest.raises(RuntimeError):
        shared_root(session("yarn"))
