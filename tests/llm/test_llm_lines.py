import random
import re

from llm_tools import ODD_TEXTS, docs, documents, prose

from newsloom.llm import line_dedup


def plain(rows, least):
    """Windows of lines to the right and to the left, in order of (doc_id, line); every later copy goes."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        lines = (text or "").split("\n")
        count = [len([w for w in re.split("[\x20\x09-\x0d]+", line) if w]) for line in lines]
        gone = set()
        for s in range(len(lines)):
            for step in (1, -1):
                total, e, held = 0, s, []
                while count[s] and 0 <= e < len(lines) and total < least:
                    if count[e]:
                        total += count[e]
                        held.append(e)
                    e += step
                if total >= least and held:
                    key = (step, *(lines[k] for k in held))
                    if key in seen:
                        gone.update(range(min(held), max(held) + 1))
                    seen.add(key)
        out[i] = (len(gone), None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def lined(seed):
    rng = random.Random(seed)
    pool = [" ".join(prose(rng, rng.choice([1, 3, 8, 20]))) for _ in range(60)] + ["", "  ", " two  blanks ", "\ttabs\tand   blanks\r"]
    shared = [[rng.choice(pool) for _ in range(rng.randrange(2, 9))] for _ in range(12)]
    rows = []
    for i in range(150):
        text = [rng.choice(pool) for _ in range(rng.randrange(6))]
        for _ in range(rng.randrange(3)):
            text += rng.choice(shared) + [rng.choice(pool)]
        rows.append((i, "\n".join(text)))
    return rows + [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)]


def test_equals_plain_search(spark):
    for seed, least in ((1, 10), (2, 25)):
        rows = lined(seed)
        got = line_dedup.delete_repeated_lines(docs(spark, rows), least).collect()
        want = plain(rows, least)
        assert {r.doc_id: (r.line_counts.n_removed, r.text) for r in got} == want
        assert sum(n > 0 for n, _ in want.values()) > 20


def test_hot_line_and_one_long_line(spark):
    hot = " ".join(f"h{k}" for k in range(60))
    rows = [(i, f"own{i} line\n{hot}\nend{i}") for i in range(200)]
    got = line_dedup.delete_repeated_lines(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.line_counts.n_removed) for r in got) == [(i, int(i > 0)) for i in range(200)]
    assert {r.text for r in got if r.doc_id == 5} == {"own5 line\nend5"}


def test_runs_go_to_their_last_line(spark):
    run = [" ".join(f"{c}{k}" for k in range(n)) for c, n in (("a", 4), ("b", 30), ("c", 21), ("d", 5), ("e", 2))]
    rows = [(i, "\n".join([f"head {i}", *run, f"tail {i}"])) for i in range(3)]
    got = {r.doc_id: r.text for r in line_dedup.delete_repeated_lines(docs(spark, rows)).collect()}
    assert got == {0: rows[0][1], 1: "head 1\ntail 1", 2: "head 2\ntail 2"}


def test_repeated_rows_null_ids_columns(spark):
    long = "\n".join(" ".join(f"{c}{k}" for k in range(30)) for c in "abc")
    rows = [(1, long), (1, long), (2, long), (None, long), (3, None), (4, "")]
    table = documents(spark, rows, extra=True)
    left = line_dedup.without_repeated_lines(table)
    assert left.columns == table.columns
    # the null id is the earliest; of the others nothing is left
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(None, long), (3, None), (4, "")], key=str)
    assert line_dedup.delete_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_between_tabs_and_double_blanks(spark):
    tabs = "\t".join(f"t{k}" for k in range(50))
    wide = "  ".join(f"b{k}" for k in range(30))  # 30 words, however many blanks
    got = {r.doc_id: r.line_counts.n_removed for r in line_dedup.delete_repeated_lines(
        docs(spark, [(1, tabs), (2, f"x\n{tabs}"), (3, wide), (4, wide)])).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 0}


def test_only_functions_of_spark(spark):
    df = line_dedup.delete_repeated_lines(docs(spark, lined(3)))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
