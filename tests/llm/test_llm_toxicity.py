import os
import random
import zlib

import numpy as np
import pytest
from llm_tools import ODD_TEXTS, docs, documents, prose

from newsloom.llm import toxicity

SF = "/root/testdata/sf0.1"


def planted(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.15
        text = prose(rng, rng.randrange(20, 80), 800)
        if bad:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["nasty", "Vile!", "foul"]))
        rows.append((i, " ".join(text)))
        if rng.random() < 0.6:
            labels.append((i, int(bad)))
    return rows, labels, None


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_learns_planted_words(spark):
    rows, labels, _ = planted(1500, 1)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs(spark, rows), marks).collect()}
    truth = {i: any(w in t.lower() for w in ("nasty", "vile", "foul")) for i, t in rows}
    assert all(r.held_out == held(i) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    wrong = sum(got[i].predicted != int(truth[i]) for i in got)
    assert wrong <= 0.02 * len(rows)


def test_labels_of_held_out_rows_are_not_read(spark):
    rows, labels, _ = planted(600, 2)
    flipped = [(i, 1 - t if held(i) else t) for i, t in labels]
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.toxicity(
        docs(spark, rows), spark.createDataFrame(own, "doc_id long, toxic int")).collect()) for own in (labels, flipped))
    assert a == b


def test_odd_rows(spark):
    rows, labels, _ = planted(400, 3)
    rows += [(2000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "nasty"), (1, rows[1][1])]
    labels += [(None, 1), (2000, None), (99999, 1), (5, 0), (5, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(docs(spark, rows), marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    table = documents(spark, rows, extra=True)
    left = toxicity.without_toxic(table, marks)
    assert left.columns == table.columns and 200 < left.count() < len(rows)


def test_nothing_to_learn_from(spark):
    rows = docs(spark, [(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.toxicity(rows, none).collect()} == {0}
    assert toxicity.toxicity(spark.createDataFrame([], "doc_id long, text string"), none).count() == 0


@pytest.mark.parametrize("unlabelled", [0, 3])
def test_learns_where_all_or_nearly_all_have_a_label(spark, unlabelled):
    rows, _, _ = planted(1500, 4)
    truth = {i: any(w in t.lower() for w in ("nasty", "vile", "foul")) for i, t in rows}
    marks = spark.createDataFrame([(i, int(truth[i])) for i, _ in rows[unlabelled:]], "doc_id long, toxic int")
    got = toxicity.toxicity(docs(spark, rows), marks).collect()
    assert sum(r.predicted != int(truth[r.doc_id]) for r in got) <= 0.02 * len(rows)
    left = toxicity.without_toxic(docs(spark, rows), marks).count()
    assert abs(left - sum(not bad for bad in truth.values())) <= 0.02 * len(rows)


def test_scores_do_not_depend_on_the_cut_of_the_tables(spark):
    rows, labels, _ = planted(700, 6)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    a, b = ({r.doc_id: r.score for r in toxicity.toxicity(docs(spark, rows, parts), own).collect()}
            for parts, own in ((1, marks), (7, marks.repartition(5))))
    assert a == b


def test_one_label_more_changes_little(spark):
    """About as many texts without a label as toxic ones: there is no number at which the training set changes."""
    rows, _, _ = planted(900, 7)
    truth = {i: any(w in t.lower() for w in ("nasty", "vile", "foul")) for i, t in rows}
    bad = sum(truth[i] and not held(i) for i, _ in rows)
    order = [i for i, _ in rows if not held(i) and not truth[i]]
    scores = []
    for open_ in (bad - 1, bad, bad + 1):
        hidden = set(order[:open_])
        marks = spark.createDataFrame([(i, int(truth[i])) for i, _ in rows if i not in hidden], "doc_id long, toxic int")
        scores.append({r.doc_id: r.score for r in toxicity.toxicity(docs(spark, rows), marks).collect()})
    assert all(abs(scores[0][i] - s[i]) < 0.1 for s in scores[1:] for i in s)


def test_risk_falls_along_its_gradient():
    """The step of the fit against a numerical gradient of the risk, written out anew."""
    rng = np.random.default_rng(3)
    params = toxicity.ToxicityParams(bits=6, min_positive=0, min_z=-1e9, epochs=1, batch=64, decay=0.0, rate=1e-7)
    rows = [np.unique(rng.integers(0, 64, size=8)) for _ in range(40)]
    marked = np.arange(40) < 15

    def risk(weights, bias, prior=0.3, share=0.2):
        value = np.array([bias + weights[r].sum() / np.sqrt(len(r)) for r in rows])
        positive = np.logaddexp(0, -value[marked]).mean()
        hidden = np.logaddexp(0, value[~marked]).mean() - share * np.logaddexp(0, value[marked]).mean()
        return prior * positive + (1 - prior) / (1 - share) * max(0.0, hidden)

    start = float(np.log(0.3 / 0.7))
    model = toxicity.fit(rows, marked, 0.3, params, 0.2)
    moved = model.weights  # one step of the first batch, in which all texts are
    slope = np.array([(risk(np.eye(64)[k] * 1e-5, start) - risk(-np.eye(64)[k] * 1e-5, start)) / 2e-5 for k in range(64)])
    clear = np.abs(slope) > 1e-4
    assert clear.sum() > 30 and (np.sign(moved[clear]) == -np.sign(slope[clear])).all()


def test_none_but_toxic_texts(spark):
    marks = spark.createDataFrame([(i, 1) for i in range(8)], "doc_id long, toxic int")
    assert all(r.score == pytest.approx(1) for r in toxicity.toxicity(docs(spark, [(i, "a b") for i in range(8)]), marks).collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no data folder")
def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.toxicity(spark.read.parquet(f"{SF}/documents.parquet"), labels).join(labels, "doc_id").filter("held_out").collect()
    score, toxic = np.array([r.score for r in got]), np.array([r.toxic == 1 for r in got])
    rank = np.empty(len(score))
    rank[np.argsort(score, kind="stable")] = np.arange(len(score))
    auc = (rank[toxic].sum() - toxic.sum() * (toxic.sum() - 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.95
    said = score >= 0.3
    assert (said & toxic).sum() / said.sum() > 0.8 and (said & toxic).sum() / toxic.sum() > 0.85
