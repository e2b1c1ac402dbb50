import numpy as np
import pytest

from newsloom.llm import embeddings as em


def plain(rows, least=0.9):
    """(vec_id, n_links, component_id, kept) by all pairs in doubles; ids may repeat."""
    good = [i for i, (vec_id, v) in enumerate(rows) if vec_id is not None and v and all(
        x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)]
    links = [[] for _ in rows]
    for i in good:
        x = np.array(rows[i][1], dtype=np.float64)
        for j in good:
            y = np.array(rows[j][1], dtype=np.float64)
            if i != j and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                links[i].append(j)
    low = {vec_id: vec_id for vec_id, _ in rows}
    moved = True
    while moved:
        moved = False
        for i, ends in enumerate(links):
            for j in ends:
                a, b = low[rows[i][0]], low[rows[j][0]]
                if a != b:
                    low[rows[i][0]] = low[rows[j][0]] = min(a, b)
                    moved = True
    return sorted((vec_id, len(links[i]), low[vec_id], vec_id is None or low[vec_id] == vec_id)
                  if vec_id is not None else (-1, 0, None, True) for i, (vec_id, _) in enumerate(rows))


def vectors(rng, n, width):
    """Groups around centres, many pairs of them close to a cosine of 0.9; and vectors of their own."""
    centres = rng.normal(size=(max(1, n // 12), width))
    out = centres[rng.integers(len(centres), size=n)] + rng.normal(size=(n, width)) * rng.choice([0.02, 0.32, 0.35, 1.0], size=(n, 1))
    return (out * rng.choice([1e-3, 1.0, 50.0], size=(n, 1))).astype(np.float32)


@pytest.mark.parametrize("seed", range(8))
def test_bounds_hold_and_decisions_are_those_of_doubles(seed):
    rng = np.random.default_rng(seed)
    width = int(rng.choice([1, 3, 64, 1500]))
    x = vectors(rng, 300, width)
    if seed % 2:
        x[:, 0] += 3 * np.abs(x).max(axis=1) * (rng.random(300) < 0.3)  # spikes make codes coarse
    q = em.quantise(x)
    exact = q.unit @ q.unit.T
    near = (q.codes * q.scale[:, None]) @ (q.codes * q.scale[:, None]).T
    e, f = q.error[:, None], q.error[None, :]
    assert (np.abs(exact - near) <= e + f * (1 + e)).all()
    for least in (0.9, 0.5, -0.2):
        want = exact >= least
        found = em.linked(q, q, least)
        got = np.zeros_like(want)
        if found is not None:
            got[np.ix_(found[0], found[1])] = found[2]
        sharp = np.abs(exact - least) > 1e-12
        assert (got == want)[sharp].all()


def run(spark, rows, kind="float", **given):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], f"vec_id long, embedding array<{kind}>, key string, n int").repartition(3)
    got = em.near_duplicates(table, em.CosineParams(**given))
    return sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, r.component_id, r.kept) for r in got.collect())


@pytest.mark.parametrize("seed", range(3))
def test_tiles_equal_all_pairs(spark, seed):
    rng = np.random.default_rng(100 + seed)
    x = vectors(rng, 250, 16)
    rows = [(int(i) * 3, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[5][1]) for i in range(20)]  # copies
    rows += [(2000 + i, (2.0 * x[7] + 1e-4 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(60)]  # near copies
    want = plain(rows)
    assert run(spark, rows) == want
    assert run(spark, rows, part=40, block=16, chunk_bytes=500) == want
    assert any(n > 50 for _, n, _, _ in want) and any(c != i for i, _, c, _ in want)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0]),
            (8, [2.0, 4.0]), (9, [1.0, 2.0]), (9, [1.0, 2.0]), (9, [-5.0, 1.0]), (10, [-10.0, 2.0]), (10, [-10.0, 2.0]),
            (None, [1.0, 2.0]), (None, None), (11, [1.0, 2.0, 0.0]), (12, [1.0, 2.0, 0.1]), (13, [5.0]), (14, [-5.0]), (15, [1e30]),
            (16, [-0.0, 1.0]), (17, [0.0, 1.0])]
    want = plain(rows)
    assert run(spark, rows) == want
    assert dict((i, n) for i, n, _, _ in want)[8] == 3
    double = rows + [(20, [1e300, -1e300]), (21, [1e-300, -1.0000001e-300])]
    assert {r[:3] for r in run(spark, double, "double")} >= {(20, 1, 20), (21, 1, 20)}


def test_nothing(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, [0.0])]) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_tiles_give_at_most_one_link_per_node():
    rng = np.random.default_rng(5)
    x = (np.ones(32) + rng.normal(size=(3000, 32)) * 0.01).astype(np.float32)
    side = em.Side(np.array([i.to_bytes(16, "big") for i in range(3000)], "V16"), np.arange(3000), np.ones(3000, np.int64), x)
    (keys, n), (a, b) = em.judge_tile(side, None, em.CosineParams(block=512))
    assert len(keys) == 3000 and (n == 2999).all() and len(a) < 3000
    low = np.arange(3000)
    for i, j in zip(a.tolist(), b.tolist()):  # each names a smaller node
        assert j < i
        low[i] = j
    while (low[low] != low).any():
        low = low[low]
    assert (low == 0).all()
