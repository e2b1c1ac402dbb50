import random
import re

import numpy as np
import pytest
from llm_tools import ODD_TEXTS, docs, documents, prose

from newsloom.llm import minhash
from newsloom.llm.components import components
from newsloom.llm.minhash import NearDuplicateParams


def plain(rows, size, percent=80):
    """Set sizes and components, by comparing all pairs."""
    sets = {}
    for i, text in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        found = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        grams = {tuple(found[k:k + size]) for k in range(len(found) - size + 1)} or ({tuple(found)} if found else set())
        sets[i] = grams
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def near_copies(seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(12):
        base = prose(rng, rng.choice([3, 8, 40, 150]))
        for rate in [0, 0] + [rng.choice([0.02, 0.05, 0.08, 0.12])] * rng.randrange(1, 14):
            rows.append(" ".join(w if rng.random() >= rate else f"z{rng.randrange(10**6)}" for w in base))
    rng.shuffle(rows)
    return list(enumerate(rows + ODD_TEXTS))


@pytest.mark.parametrize("seed, params", [
    (1, NearDuplicateParams(shingle=2)), (2, NearDuplicateParams()), (3, NearDuplicateParams(shingle=2, tile=3)),
    (4, NearDuplicateParams(shingle=1, tile=2))])
def test_groups_equal_plain_comparison(spark, seed, params):
    rows = near_copies(seed)
    got = minhash.near_duplicates(docs(spark, rows), params).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain(rows, params.shingle)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_signatures_estimate_similarity_with_less_spread():
    rng = np.random.default_rng(3)
    values, counts = [], []
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, 180, dtype=np.uint64)
        values += [pool[:162], pool[18:]]
        counts += [162, 162]
    found = minhash.signatures(np.concatenate(values), np.concatenate([[0], np.cumsum(counts)]), 128)
    agree = (found[0::2] == found[1::2]).mean(axis=1)
    assert abs(agree.mean() - 0.8) < 0.01
    assert agree.std() < 0.9 * (0.16 / 128) ** 0.5  # of independent hashes
    assert (found != minhash._NONE).all()


def test_repeated_ids_null_ids_and_no_rows(spark):
    text = " ".join(f"v{i}" for i in range(30))
    rows = [(5, text), (5, text), (5, "quite another text"), (8, text), (None, text), (None, text), (9, None)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 5, True)] * 3 + [(8, 5, False)] + [(None, None, True)] * 2 + [(9, 9, True)], key=str)
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_representatives_keep_columns(spark):
    rows = near_copies(5)
    table = documents(spark, rows, extra=True)
    stay = minhash.representatives(table)
    assert stay.columns == table.columns
    want = {i for i, (_, c) in plain(rows, 5).items() if i == c}
    assert {r.doc_id for r in stay.collect()} == want


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 400)] + [(1000, 1000 + i) for i in range(300)] + [(5000 - i, 4999 - i) for i in range(200)]
    links += [(7000, 7000), (None, 3), (9001, 9000), (9000, 9001)]
    rng.shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    assert all(got[i] == 0 for i in range(1, 401)) and all(got[i] == 1000 for i in range(1001, 1300))
    assert all(got[i] == 4800 for i in range(4801, 5001)) and got[9001] == 9000
    assert all(got.get(i, i) == i for i in (0, 1000, 4800, 7000, 9000))
