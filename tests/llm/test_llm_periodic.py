import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_tools import ODD_TEXTS, documents, docs

from newsloom.llm import periodic_runs as pr


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if w[q:] == w[:len(w) - q])


def plain_runs(w, least=24, times=3):
    """Every lag, every stretch; only those whose own smallest period is the lag."""
    out = set()
    n = len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, times * q) and smallest_period(w[i:j + q]) == q:
                out.add((i, j + q - i, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain(doc_id, text, weave=True):
    w = [x for x in re.split("[\x20\x09-\x0D]+", text or "") if x]
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if weave and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def found(w, **given):
    ids = np.array([zlib.crc32(str(x).encode()) for x in w], dtype=np.uint64)
    runs = pr.runs_of_block(ids, np.array([0, len(w)]), pr.RunParams(**given))[0]
    return list(zip(*(x.tolist() for x in runs)))


def some_words(rng, n):
    """Words with runs of many periods, also of runs within runs."""
    out = []
    while len(out) < n:
        unit = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.choice([1, 2, 3, 5, 8, 15, 16, 17, 31, 32, 33, 60]))]
        if rng.random() < 0.3:
            unit = unit * rng.randrange(2, 12) + [99]
        out += unit * rng.randrange(1, 9) + unit[:rng.randrange(len(unit) + 1)] + [rng.randrange(1000) for _ in range(rng.randrange(4))]
    return out[:n]


@pytest.mark.parametrize("seed", range(60))
def test_runs_equal_all_lags(seed):
    rng = random.Random(seed)
    w = some_words(rng, rng.randrange(20, 500))
    assert found(w) == plain_runs(w)
    assert found(w, short=4) == plain_runs(w)
    assert found(w, least=6, short=2) == plain_runs(w, least=6)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=20, max_size=160))
def test_runs_of_few_letters(w):
    assert found(w) == plain_runs(w)
    assert found(w, least=4, short=2) == plain_runs(w, least=4)


def test_equal_words_and_words_of_thue_and_morse():
    assert found([7] * 5000) == [(0, 5000, 1)]
    assert found([7] * 23) == [] and found([7] * 24) == [(0, 24, 1)]
    morse = [bin(i).count("1") & 1 for i in range(4096)]  # cube-free; prefix hashes of it collide
    assert found(morse) == []
    assert found(morse * 3 + [5]) == [(0, 3 * 4096, 4096)]


def test_long_text_in_few_steps():
    rng = random.Random(1)
    w = [rng.randrange(2000) for _ in range(200_000)]
    assert found(w * 3 + [-1] + [1, 2] * 100_000) == [(0, 600_000, 200_000), (600_001, 200_000, 2)]
    assert found([1, 2] * 400_000 + [3] + [1, 2] * 400_000) == [(0, 800_000, 2), (800_001, 800_000, 2)]


def test_several_documents_share_no_run():
    ids = np.array([1, 2] * 30 + [1, 2] * 5 + [3] * 40, dtype=np.uint64)
    runs = pr.runs_of_block(ids, np.array([0, 0, 60, 70, 110, 110]))
    assert [list(zip(*(x.tolist() for x in r))) for r in runs] == [[], [(0, 60, 2)], [], [(0, 40, 1)], []]


def test_rows(spark):
    rng = random.Random(3)
    texts = [*ODD_TEXTS, " ".join(["to be  or\tnot"] * 40), "a b " * 11 + "a b", "a b " * 12,
             *(" ".join(f"w{x}" for x in some_words(rng, rng.randrange(1, 400))) for _ in range(60))]
    rows = [(k * 7 - 20, t) for k, t in enumerate(texts)] + [(None, texts[-1]), (15, "x " * 30), (15, "x " * 30)]
    want = sorted((str(i), *map(str, plain(i, t))) for i, t in rows)
    for table in (docs(spark, rows), documents(spark, rows, extra=True)):
        got = pr.periodic_runs(table, weave=True)
        assert sorted(tuple(map(str, r)) for r in got.collect()) == want
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and t for i, t in rows if i is not None)
    plainly = pr.periodic_runs(docs(spark, rows)).collect()
    assert sorted(tuple(map(str, r)) for r in plainly) == sorted((str(i), *map(str, plain(i, t, False))) for i, t in rows)
    assert pr.periodic_runs(spark.createDataFrame([], "doc_id long, text string"), weave=True).count() == 0
