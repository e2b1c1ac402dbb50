import random

import numpy as np
import pyarrow as pa
import pytest
from llm_tools import ODD_TEXTS, docs
from pyspark.sql import functions as F

from newsloom.llm import suffixes
from newsloom.llm.storage import settings, stored
from newsloom.llm.suffixes import RepeatParams


def plain(rows, length):
    first, out = set(), {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            key = raw[s:s + length]
            if key in first:
                gone[s:s + length] = b"\1" * length
            first.add(key)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(raw), sum(gone), runs, bytes(x for x, g in zip(raw, gone) if not g))
    return out


def planted(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab cdé") for _ in range(600)) for _ in range(5)]
    rows = [(0, "a" * 500), (1, "a" * 130), (2, "ab" * 300), (3, "x" * 99)]
    for i in range(4, 60):
        text = rng.choice(base)
        at = rng.randrange(500)
        text = text[at:at + rng.randrange(90, 400)]
        if rng.random() < 0.5:
            text += rng.choice(base)[:rng.randrange(200)]
        if rng.random() < 0.3:
            at = rng.randrange(len(text))
            text = text[:at] + "#" + text[at + 1:]
        rows.append((i, text))
    return rows + [(100 + i, t) for i, t in enumerate(ODD_TEXTS)]


@pytest.mark.parametrize("seed, params", [(1, RepeatParams()), (2, RepeatParams(split_from=2)), (3, RepeatParams(length=40, gram=12))])
def test_equals_plain_search(spark, seed, params):
    rows = planted(seed)
    got = suffixes.remove_repeats(docs(spark, rows, 4), params).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == plain(rows, params.length)
    assert all(sum(s["count"] for s in r.spans) == r.n_removed for r in got)


def test_repeated_rows_and_ids(spark):
    rng = random.Random(4)
    one, two = ("".join(rng.choice("abcdef ") for _ in range(300)) for _ in range(2))
    rows = [(1, one), (1, one), (2, one + two), (2, two), (None, one), (3, two)]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in suffixes.remove_repeats(docs(spark, rows, 2)).collect()), key=str)
    # the null id comes first; of the two texts with id 2, one has the first copy of the second text
    assert got[:2] == [(1, 300, 300)] * 2 and (None, 300, 0) in got and (3, 300, 300) in got
    assert sorted(n for i, _, n in got if i == 2) in ([0, 600], [300, 300])
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_refinement_is_exact():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    for length in (20, 100):
        pointer = suffixes.refine(data, suffixes._depths(length))
        raw, names = data.tobytes(), {}
        for k in range(len(raw) - length):
            assert names.setdefault(raw[k:k + length], pointer[k]) == pointer[k]
        assert len(set(names.values())) == len(names)


def shared_passage(n):
    """A passage of 200 bytes in ``n`` texts, between neighbours of their own."""
    rng = random.Random(6)
    one = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    passage = one(200)
    return [(i, one(150) + passage + one(150)) for i in range(n)]


def test_large_buckets_are_spread(spark):
    rows, params, parts = shared_passage(300), RepeatParams(split_from=50), 4
    keyed = suffixes._keyed(docs(spark, rows, parts))
    large = suffixes._large(keyed, params)
    assert large.count() >= 2  # the passage's ends
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = suffixes._dealt(suffixes._anchors(keyed, params), large)
        tasks = dealt.withColumn("task", F.spark_partition_id()).filter("wide").groupBy("bucket").agg(F.countDistinct("task").alias("n"))
        assert min(r.n for r in tasks.collect()) > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    found = stored(suffixes._buckets(dealt, params), "buckets")
    assert found.filter(F.col("state") == suffixes.WIDE).count() > 300
    fetched = suffixes._fetched(keyed, found, params).filter("bytes IS NOT NULL")
    assert max(r["count"] for r in fetched.groupBy("bytes").count().collect()) <= 2 * parts  # a batch or so per task
    got = suffixes.remove_repeats(docs(spark, rows, parts), params).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == plain(rows, params.length)


def test_buckets_with_one_stretch_a_batch_are_counted(spark):
    rows, params = shared_passage(40), RepeatParams(split_from=30)
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "1"}):
        large = suffixes._large(suffixes._keyed(docs(spark, rows, 2)), params)
        assert large.count() >= 2
        got = suffixes.remove_repeats(docs(spark, rows, 2), params).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == plain(rows, params.length)


def test_many_large_buckets_are_joined(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "_BROADCAST_ROWS", 1)
    monkeypatch.setattr(suffixes, "_SORTED", 100)
    monkeypatch.setattr(suffixes, "_CHUNK", 100)
    rows, params = shared_passage(60) + [(1000 + i, t) for i, t in planted(7)], RepeatParams(split_from=10)
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        got = suffixes.remove_repeats(docs(spark, rows, 3), params).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == plain(rows, params.length)


@pytest.mark.parametrize("room", [1, 100, 3_000, 10**9])
def test_buckets_are_read_whole(room):
    rng = random.Random(room)
    bucket = sorted(rng.choice([1, 2, 2, 2, rng.randrange(50)]) for _ in range(1000))
    table = pa.table({"bucket": pa.array(bucket, pa.int64()), "at": list(range(1000))})
    parts = list(suffixes.whole_buckets(iter([b for k in range(0, 1000, 7) for b in table.slice(k, 7).to_batches()]), room))
    assert pa.concat_tables(parts).equals(table)
    assert sum(len(set(p.column("bucket").to_pylist())) for p in parts) == len(set(bucket))
    assert len(parts) > 1 if room < 10**9 else len(parts) == 1
