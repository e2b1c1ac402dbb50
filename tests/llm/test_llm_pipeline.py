import os
import random

import corpus_pipeline
import pytest
from llm_tools import ODD_TEXTS, documents, prose
from test_llm_decontamination import plain as passage_in
from test_llm_lines import plain as without_lines
from test_llm_minhash import plain as near_groups

from newsloom.llm.storage import passing_tables, stored
from newsloom.session import scratch_path, shared_root


def corpus(seed):
    rng = random.Random(seed)
    rows, labels = [], []
    items = [(k, " ".join(prose(rng, 25))) for k in range(10)]
    boiler = "\n".join(" ".join(prose(rng, 35)) for _ in range(2))
    for i in range(500):
        own = [prose(rng, rng.randrange(15, 40)) for _ in range(rng.randrange(1, 4))]
        if i % 7 == 0:
            own[0][3:3] = ["nasty", "vile", "nasty"]
        text = "\n".join(" ".join(line) for line in own)
        if i % 11 == 0:
            text += "\n" + boiler
        if i % 13 == 0:
            text += "\n" + rng.choice(items)[1]
        rows.append((i, text))
        if i % 5 < 3:
            labels.append((i, 1, int(i % 7 == 0)))
    for i in range(500, 540):  # copies with a word changed
        words = rows[i - 400][1].split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    rows += [(600 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "a row without an id"), (601, "")]
    return rows, labels, items


@pytest.fixture(scope="module")
def folder(spark):
    rows, labels, items = corpus(1)
    path = scratch_path(spark, "corpus")
    documents(spark, rows, extra=True).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


def test_stages_equal_plain_versions(spark, folder):
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").filter("doc_id IS NOT NULL").collect()}
        out = corpus_pipeline.stored(stage(spark, docs, path), name)
        if k == 4:
            break
        after = {r.doc_id: r.text for r in out.select("doc_id", "text").filter("doc_id IS NOT NULL").collect()}
        assert out.columns == columns and out.filter("doc_id IS NULL").count() == 1
        if name == "toxicity":
            assert after == {i: t for i, t in before.items() if not (t and "nasty" in t)}
        elif name == "line_dedup":
            # the row without an id comes first and shares no run
            want = {i: t for i, (n, t) in without_lines(before.items(), 50).items() if not (n and not t.strip(" "))}
            assert after == want and sum(after[i] != before[i] for i in after) > 20
        elif name == "near_dedup":
            groups = near_groups(before.items(), 5)
            assert set(after) == {i for i, (_, c) in groups.items() if c == i} and len(after) < len(before)
        else:
            clean = {i for i, t in before.items() if not any(passage_in(t or "", item) for _, item in items)}
            assert set(after) == clean and len(clean) < len(before)
        docs = out
    lengths = {i: len((t or "").split()) for i, t in before.items()}
    packed = {}
    for r in out.filter("doc_id IS NOT NULL").collect():
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
    assert packed == lengths


def test_run_equals_its_stages_and_empty_tables_work(spark, folder):
    path, _ = folder
    assert corpus_pipeline.run(spark, path).count() > 300
    none = scratch_path(spark, "empty")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{none}/{name}.parquet")
    assert corpus_pipeline.run(spark, none).count() == 0


def test_passing_tables_go_also_after_a_failure(spark):
    kept = stored(spark.range(3), "kept")
    path = scratch_path(spark, "named")
    with pytest.raises(ValueError), passing_tables(spark):
        gone = stored(spark.range(4), "gone")
        named = stored(gone, "named", path)
        raise ValueError
    assert kept.count() == 3 and named.count() == 4 and stored(spark.range(2), "later").count() == 2
    assert not [name for name in os.listdir(shared_root(spark)) if name.startswith("gone-")]
