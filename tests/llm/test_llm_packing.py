import random

import pytest
from llm_tools import docs

from newsloom.llm import packing
from newsloom.llm.packing import PackingParams

SMALL = PackingParams(capacities=(8, 16, 40), fixed_cost=2.0, pieces_a_shard=50)


def plain_best_fit(lengths, params):
    """The same rule by looking at all open bins."""
    bins, out, left = [], [], sum(lengths)
    for length in lengths:
        fits = [(room, k) for k, (room, _) in enumerate(bins) if room >= length]
        if fits:
            k = min(fits)[1]
        else:
            capacity = min((c for c in sorted(params.capacities) if c >= length),
                           key=lambda c: (params.cost(c) / (length + min(c - length, left - length)), c))
            bins.append((capacity, 0))
            k = len(bins) - 1
        room, fill = bins[k]
        out.append((k, fill))
        bins[k] = (room - length, fill + length)
        left -= length
    return out, [min(c for c in params.capacities if c >= fill) for _, fill in bins]


@pytest.mark.parametrize("seed", range(8))
def test_pack_equals_plain_best_fit(seed):
    rng = random.Random(seed)
    lengths = sorted((rng.randrange(1, 41) for _ in range(rng.randrange(1, 300))), reverse=True)
    bins, offsets, capacity = packing.pack(lengths, SMALL)
    assert (list(zip(bins, offsets)), capacity) == plain_best_fit(lengths, SMALL)


def test_every_token_is_in_one_place(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(0, 130)) for i in range(300)] + [(7, 5), (7, 5), (None, 12), (1000, None), (1001, -3)]
    lengths = spark.createDataFrame(rows, "doc_id long, length long").repartition(4)
    out = packing.best_fit(lengths, SMALL).collect()
    full = [r for r in out if r.length]
    assert sum(r.length for r in full) == sum(max(0, n or 0) for _, n in rows)
    assert sum(not r.length for r in out) == sum(max(0, n or 0) == 0 for _, n in rows)
    assert all(r.bin_id is None and r.capacity is None for r in out if not r.length)
    bins = {}
    for r in full:
        bins.setdefault(r.bin_id, []).append(r)
    for held in bins.values():
        held.sort(key=lambda r: r.offset)
        assert [r.offset for r in held] == [sum(x.length for x in held[:k]) for k in range(len(held))]
        fill = sum(r.length for r in held)
        assert {r.bin_fill for r in held} == {fill}
        assert {r.capacity for r in held} == {min(c for c in SMALL.capacities if c >= fill)}
    assert sum(len(h) for h in bins.values()) / len(bins) > 1.2
    assert sum(h[0].capacity for h in bins.values()) < 1.1 * sum(r.length for r in full)


def test_long_documents_are_cut(spark):
    out = packing.best_fit(docs(spark, [(1, " ".join("x" * 95))]).selectExpr("doc_id", "95L AS length"), SMALL).collect()
    assert sorted((r.piece, r.start, r.length) for r in out) == [(0, 0, 40), (1, 40, 40), (2, 80, 15)]


def test_no_rows_and_word_lengths(spark):
    assert packing.best_fit(spark.createDataFrame([], "doc_id long, length long")).count() == 0
    got = packing.word_lengths(docs(spark, [(1, "a  b\n\tc"), (2, None), (3, ""), (4, "é\x0bf")])).collect()
    assert {r.doc_id: r.length for r in got} == {1: 3, 2: 0, 3: 0, 4: 2}


def test_equal_rows_are_spread_over_shards(spark):
    rows = [(None, 7)] * 300 + [(5, 7)] * 300
    table = spark.createDataFrame(rows, "doc_id long, length long").repartition(3)
    got = packing.best_fit(table, SMALL).collect()
    assert len(got) == 600 and len({r.bin_id.split("-")[0] for r in got}) == 12
