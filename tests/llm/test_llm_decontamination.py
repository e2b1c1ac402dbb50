import random
from itertools import combinations

import numpy as np
from llm_tools import ODD_TEXTS, docs, documents, prose

from newsloom.llm import decontamination
from newsloom.llm.decontamination import SeedParams


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").repartition(2)


def found(spark, rows, items, params=SeedParams()):
    return {r.doc_id: r for r in decontamination.contamination(docs(spark, rows), bench(spark, items), params).collect()}


def plain(text, item, window=13, percent=80):
    """Any alignment with a window of enough equal words."""
    own, other = text.lower().split(), item.lower().split()
    size = min(window, len(other))
    for offset in range(-len(other), len(own)):
        equal = [0 <= k + offset < len(own) and own[k + offset] == w for k, w in enumerate(other)]
        if any(100 * sum(equal[k:k + size]) >= percent * size for k in range(len(other) - size + 1)):
            return True
    return False


def test_contiguous_passages_equal_plain_search(spark):
    rng = random.Random(7)
    items = [(k, " ".join(prose(rng, rng.choice([1, 2, 4, 5, 6, 9, 12, 20, 45])))) for k in range(30)]
    rows = []
    for k in range(120):
        own = prose(rng, rng.randrange(0, 80))
        if k % 2:
            piece = rng.choice(items)[1].upper().split()
            cut = rng.choice([len(piece), len(piece), 13, 4])
            at = rng.randrange(len(own) + 1)
            own[at:at] = piece[:cut]
        rows.append((k, " ".join(own)))
    got = found(spark, rows, items)
    want = {i: sorted(k for k, item in items if plain(text, item)) for i, text in rows}
    assert {i: r.items for i, r in got.items()} == want
    assert all(r.contaminated == bool(want[i]) and r.n_items == len(want[i]) for i, r in got.items())
    assert sum(map(bool, want.values())) > 40


def test_replaced_words_are_tolerated(spark):
    rng = random.Random(8)
    items = [(k, " ".join(prose(rng, 40))) for k in range(40)]
    rows = []
    for k, (_, text) in enumerate(items * 3):
        changed = [w if rng.random() > 0.08 else "changed" for w in text.split()]
        rows.append((k, " ".join(prose(rng, 30) + changed + prose(rng, 20))))
    rows += [(500 + k, " ".join(prose(rng, 200))) for k in range(100)]
    got = found(spark, rows, items)
    assert sum(k % 40 in got[k].items for k in range(120)) >= 117
    assert not any(got[500 + k].contaminated for k in range(100))


def test_repeated_items_and_hot_passages(spark):
    rng = random.Random(9)
    items = [(k, " ".join(prose(rng, 20))) for k in range(30)] + [(3, "the same id with another text of many words here"), (40, None), (None, " ".join(prose(rng, 9)))]
    items += [items[0], (31, items[0][1])]  # repeated whole; the same text under another id
    rows = [(k, " ".join(prose(rng, 10)) + " " + (items[k % 33][1] or "") + " " + items[0][1]) for k in range(66)]
    got = found(spark, rows, items)
    assert all(r.contaminated and {0, 31} <= set(r.items) for r in got.values())
    assert got[3].items == [0, 3, 31] and got[3].n_items == 3 and got[30].items == [0, 3, 31]
    assert got[32].items == [0, 31] and got[32].n_items == 3  # the item without an id counts


def test_odd_rows(spark):
    items = [(1, "one two three four five six seven"), (2, "too short"), (3, ""), (4, None)]
    rows = list(enumerate(ODD_TEXTS)) + [(50, "two short"), (51, "x ONE, two; three four FIVE six seven y"), (None, items[0][1]), (51, "clean")]
    got = decontamination.contamination(docs(spark, rows), bench(spark, items)).collect()
    assert len(got) == len(rows)
    assert sorted(str(r.doc_id) for r in got if r.contaminated) == ["51", "None"]
    short = decontamination.contamination(docs(spark, [*rows, (60, "it is TOO-SHORT for that")]), bench(spark, items)).collect()
    assert {r.doc_id: r.items for r in short if r.contaminated and r.doc_id} == {51: [1], 60: [2]}
    table = documents(spark, rows, extra=True)
    left = decontamination.without_contaminated(table, bench(spark, items))
    assert left.columns == table.columns and left.count() == len(rows) - 2
    assert decontamination.without_contaminated(table, spark.createDataFrame([], "item_id long, text string")).count() == len(rows)
    assert decontamination.contamination(spark.createDataFrame([], "doc_id long, text string"), bench(spark, items)).count() == 0


def test_all_patterns_of_replaced_words_are_found(spark):
    items, rows = [], []
    for n in range(1, 14):
        item = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        for pattern in combinations(range(n), n // 5):
            text = ["before", *(f"x{k}" if k in pattern else w for k, w in enumerate(item)), "after"]
            rows.append((100_000 * n + len(rows), " ".join(text)))
        if n < 5:  # none may be replaced
            rows.append((-n, " ".join(["before", "x", *item[1:]])))
    got = found(spark, rows, items)
    assert {i: r.items for i, r in got.items()} == {i: [i // 100_000] if i > 0 else [] for i, _ in rows}


def test_the_driver_sees_no_benchmark_text(spark):
    """Two documents, one passage: the plan joins seeds, and only the bit table and sizes are fetched."""
    rng = random.Random(10)
    items = [(k, " ".join(prose(rng, 30))) for k in range(5)]
    seeds = decontamination.item_seeds(decontamination.benchmark_items(bench(spark, items)), SeedParams())
    table = decontamination.screen(seeds)
    keys = np.array([r.key for r in seeds.collect()], dtype=np.int64).view(np.uint64)
    assert decontamination._passes(table, keys).all()
    assert decontamination._passes(table, np.random.default_rng(1).integers(0, 1 << 63, 100_000, dtype=np.uint64)).mean() < 1e-3
