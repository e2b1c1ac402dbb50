import hashlib
import random
import re

import numpy as np
import pytest
from llm_tools import ODD_TEXTS, docs

from newsloom.llm import exact_dedup


def plain(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), i is None, i or 0, i))
    out = []
    for key, held in groups.items():
        keep = min(held)[3]
        for k, row in enumerate(sorted(held)):
            out.append((row[3], keep, len(held), k == 0, hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("first", ["pmod(xxhash64(doc_id), 2) = 0", "true", "false", "doc_id < 40"])
def test_equals_plain_groups(spark, first):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \té日") for _ in range(rng.randrange(8))) for _ in range(40)]
    rows = [(i, rng.choice(texts)) for i in range(300)] + [(400 + i, t) for i, t in enumerate(ODD_TEXTS)]
    rows += [(7, rows[7][1]), (None, "ab"), (None, "ab"), (None, None)]
    got = exact_dedup.exact_duplicates(docs(spark, rows), first).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 60_000])
def test_filter_has_all_keys_and_few_others(n):
    keys = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)
    fuse = exact_dedup.Fuse.build(np.unique(keys))
    assert fuse.has(keys).all()
    others = np.random.default_rng(n + 1).integers(1 << 63, 1 << 64, 100_000, dtype=np.uint64)
    assert fuse.has(others).mean() < 1e-3
    assert n < 10_000 or len(fuse.prints) < 1.3 * n


def test_screen_lets_known_digests_pass(spark):
    rows = [(i, f"text {i}") for i in range(2000)]
    known = exact_dedup.write_snapshot(exact_dedup.groups(exact_dedup.digests(docs(spark, rows[:1000])).selectExpr("*", "1L AS row")))
    batch = exact_dedup.groups(exact_dedup.digests(docs(spark, rows[500:])).selectExpr("*", "1L AS row"))
    got = {r.best.doc_id: r.maybe for r in exact_dedup.screen(batch, known).collect()}
    assert len(got) == 1500 and all(got[i] for i in range(500, 1000)) and sum(got.values()) < 510


def test_no_rows(spark):
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_batch_larger_than_its_snapshot_is_dealt_over_parts(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "DIGESTS_A_BUCKET", 50)
    rows = [(i, f"text {i % 600}") for i in range(900)]
    got = exact_dedup.exact_duplicates(docs(spark, rows), "doc_id < 30").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)


def _weak():
    return lambda raw: hashlib.sha256(raw[:1]).digest()  # made here, as tasks can't import this file


def test_texts_of_one_key_are_told_apart_by_their_bytes(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab \té") for _ in range(rng.randrange(6))) for _ in range(30)]
    rows = [(i, rng.choice(texts)) for i in range(200)] + [(None, "ab"), (None, "ab"), (300, None)]
    given = docs(spark, rows).repartition(5)
    met = exact_dedup.digests(given, strong=_weak(), second=_weak())
    assert exact_dedup.differing_texts(given, met, _weak(), _weak()).count() > 1
    got = exact_dedup.exact_duplicates(given, strong=_weak(), second=_weak()).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == sorted((r[:4] for r in plain(rows)), key=str)


def test_only_texts_that_met_another_are_compared(spark):
    rows = [(i, f"a b{i}") for i in range(50)] + [(90 + i, "ab 7") for i in range(50)]
    given = docs(spark, rows)
    met = exact_dedup.groups(exact_dedup.digests(given).selectExpr("*", "1L AS row")).filter("group_size > 1")
    assert met.count() == 1 and exact_dedup.differing_texts(given, met).count() == 0
    none = exact_dedup.differing_texts(given, met.filter("false"), _weak(), _weak())
    assert none.count() == 0  # one key and many texts, but nothing has met
