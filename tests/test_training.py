import random
from dataclasses import replace

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from newsloom.checks import model_checks
from newsloom.functions.stemming import porter_stem
from newsloom.operators import features, metrics
from newsloom.plans import scoring, training
from newsloom.plans.corpus import prepare
from newsloom.sources import requests

REAL = "council approved budget report minister said growth figures committee vote".split()
FAKE = "miracle secret shocking cure aliens hidden truth banned instantly doctors".split()


@pytest.fixture(scope="module")
def corpus(spark):
    rows = []
    for i in range(90):
        pool, label = (REAL, 1) if i % 3 else (FAKE, 0)
        text = " ".join(porter_stem(pool[(i * k + k) % 10]) for k in range(1, 8)) + f" common word{i % 5}"
        rows.append((str(i), text, label))
    return spark.createDataFrame(rows, "doc_id string, processed_text string, label int")


SETTINGS = training.TrainSettings(max_features=200, folds=3, max_iter=30)


@pytest.fixture(scope="module")
def trained(corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("model"))
    result = training.train(corpus, path, SETTINGS)
    training.save(result, path, SETTINGS)
    return result, path


def test_stages_equal_the_long_form(spark, corpus):
    model = features.CredibilityClassifier(max_features=60, max_iter=2).fit(corpus)
    vocab = model.stages[3].vocabulary
    wide = model.transform(corpus).select("doc_id", vector_to_array("features").alias("v")).collect()
    ours = {(r.doc_id, vocab[i]): round(x, 4) for r in wide for i, x in enumerate(r.v) if x}
    rows = features.tfidf_rows(corpus, "doc_id", "processed_text", 60).collect()
    assert ours == pytest.approx({(r.doc, r.term): r.weight for r in rows}, abs=2e-4)
    assert "common" not in vocab                     # in every document: above the share of 0.95


def test_train_separates_and_reports(trained):
    result, _ = trained
    assert result.accuracy == 1.0 and result.cv_mean > 0.95 and 0 <= result.cv_std < 0.1
    assert result.majority_share == pytest.approx(2 / 3, abs=0.01)
    counts = {(r.label, r.is_test): r["count"] for r in result.split.groupBy("label", "is_test").count().collect()}
    assert counts == {(0, False): 24, (0, True): 6, (1, False): 48, (1, True): 12}


def test_save_load_evaluate(spark, corpus, trained):
    result, path = trained
    model, facts, split = training.load(spark, path)
    assert facts.first().accuracy == result.accuracy
    report = training.evaluate(model, corpus, split)
    assert report["accuracy"].first().accuracy == 1.0
    assert {(r.label, r.predicted_0, r.predicted_1) for r in report["confusion_matrix"].collect()} == {
        (0, 6, 0), (1, 0, 12)}
    lines = {r["class"]: r for r in report["classification_report"].collect()}
    assert set(lines) == {"0", "1", "accuracy", "macro avg", "weighted avg"} and lines["1"].support == 12
    assert report["sample_predictions"].count() == 10


def test_scoring_rows_and_errors(spark, trained):
    model = trained[0].model
    rows = [(0, "Council", "approved budget report, minister said"), (1, None, "shocking miracle cure"),
            (2, "title only", " "), (3, "", "the of and"), (4, "x", None)]
    df = requests.from_records(spark.createDataFrame(rows, "idx int, title string, content string"))
    got = {r.idx: r for r in scoring.score_texts(df, model).collect()}
    assert (got[0].prediction, got[1].prediction) == ("Real", "Fake")
    for i in (0, 1):
        r = got[i]
        assert r.fake_probability + r.real_probability == pytest.approx(1)
        assert r.confidence == r.reliability_score == max(r.fake_probability, r.real_probability)
        assert r.error is None and r.interpretation
    assert (got[1].text_length, got[0].text_length) == (21, 45)
    for i, text in ((2, "No text provided"), (3, "no meaningful content"), (4, "No text provided")):
        assert got[i].prediction is None and got[i].confidence is None and text in got[i].error
    loose = {r.idx: r for r in scoring.score_texts(df, model, validate=False).collect()}
    assert loose[2].error is None and loose[2].prediction in ("Real", "Fake")
    bare = spark.createDataFrame([("miracle secret",)], "content string").withColumn("idx", F.lit(7))
    assert scoring.score_texts(requests.from_records(bare, title=None), model).first().prediction == "Fake"
    s = metrics.batch_summary(scoring.score_texts(df, model)).first()
    assert (s.total_texts, s.successful_predictions, s.fake_count, s.real_count, s.error_count,
            s.fake_percentage) == (5, 2, 1, 1, 3, 50.0)


def test_scoring_pages(spark, trained):
    pages = spark.createDataFrame([
        (1, "u1", "<title>Council</title><article>" + "approved budget report minister said. " * 20 + "</article>"),
        (2, "u2", None), (3, "u3", "<p> </p>")], "page_id bigint, url string, html string")
    got = {r.idx: r for r in scoring.score_pages(pages, trained[0].model).collect()}
    assert got[1].prediction == "Real" and got[1].url == "u1" and got[1].extracted_title == "Council"
    assert len(got[1].extracted_content_preview) == 503
    assert got[2].error.startswith("page cannot be read") and got[3].error == "No text provided for prediction"


def test_scoring_has_no_shuffle(spark, trained):
    df = requests.from_records(spark.createDataFrame([(1, "a", "b")], "idx int, title string, content string"))
    assert "Exchange" not in scoring.score_texts(df, trained[0].model)._jdf.queryExecution().executedPlan().toString()


def test_interpretation_bounds(spark):
    df = spark.createDataFrame([("Fake", 0.8), ("Fake", 0.81), ("Real", 0.6), ("Real", 0.61), ("Real", 0.9), (None, None)],
                               "n string, c double")
    got = [r.t for r in df.select(metrics.interpretation("n", "c").alias("t")).collect()]
    assert got == [metrics.MODERATE["Fake"], metrics.HIGH["Fake"], metrics.LOW, metrics.MODERATE["Real"],
                   metrics.HIGH["Real"], None]


def test_report_with_a_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 1), (1, 1), (1, 1)], "label int, prediction int")
    lines = {r["class"]: (r.precision, r.recall, r.f1, r.support) for r in metrics.classification_report(df).collect()}
    assert lines["0"] == (0.0, 0.0, 0.0, 1) and lines["1"] == (0.6667, 1.0, 0.8, 2)
    assert metrics.batch_summary(df.filter("label > 5").select(F.lit("Real").alias("prediction"))).first().fake_percentage == 0


def test_quick_sample_is_smaller_than_the_corpus(corpus):
    split = training.assign_split(corpus, training.TrainSettings(sample_size=40, folds=2))
    assert split.count() == 40 and split.filter("is_test").count() == 8


def _gram_rows(seed, n, words):
    rng = random.Random(seed)
    texts = [" ".join(f"w{min(int(rng.expovariate(0.03)), words)}" for _ in range(rng.randrange(12))) for _ in range(n)]
    return [(i, i % 3, t or None) for i, t in enumerate(texts)]


@pytest.mark.parametrize("cells, wanted", [(1, 5), (8, 5), (64, 5), (64, 40), (1024, 12), (1 << 20, 12), (1 << 20, 100_000), (64, 0)])
def test_screened_terms_are_those_of_the_whole_count(spark, monkeypatch, cells, wanted):
    monkeypatch.setattr(features, "FIRST_CELLS", 1)     # so that more cells have to be counted
    docs = spark.createDataFrame(_gram_rows(cells + wanted, 120, 150), "doc_id int, fold int, text string").repartition(4)
    rows = docs.select("fold", features.grams("text").alias("grams"))
    every = features.gram_statistics(rows, "grams", 3)
    whole = features.vocabulary(every, F.lit(120), wanted).select("term", "df", "total").collect()
    assert features.frequent_terms(rows, "grams", 120, wanted, cells=cells).collect() == whole
    screened = features.frequent_statistics(rows, "grams", {None: 120, 0: 80, 1: 80, 2: 80}, wanted, cells=cells)
    for fold, size in ((None, 120), (0, 80), (1, 80), (2, 80)):
        got, want = (features.vocabulary(features.without_fold(s, fold), F.lit(size), wanted).collect() for s in (screened, every))
        assert got == want and len(got) <= wanted
        if fold is not None and wanted:
            others = rows.filter(F.col("fold") != fold)
            assert got == features.vocabulary(features.gram_statistics(others, "grams"), F.lit(size), wanted).collect()


def test_cells_bound_their_terms_and_what_is_counted(spark):
    docs = spark.createDataFrame(_gram_rows(9, 200, 400), "doc_id int, fold int, text string")
    rows = docs.select("fold", features.grams("text").alias("grams"))
    sums = features.cell_sums(rows, "grams", 3, 32)
    every = features.gram_statistics(rows, "grams")
    assert sums.count() == 32 and sums.agg(F.sum("total")).first()[0] == every.agg(F.sum("total")).first()[0]
    assert sums.filter("total <> total_0 + total_1 + total_2").isEmpty()
    few = features.frequent_statistics(rows, "grams", {None: 200}, 3)
    assert 3 <= few.count() < every.count() / 10


def test_screen_of_no_terms(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string")
    assert features.frequent_terms(docs.select(features.grams("text").alias("grams")), "grams", 2).isEmpty()


def test_texts_are_stemmed_once_and_only_where_they_are_labelled(spark):
    texts = spark.createDataFrame([(1, "Council", "voted on budgets"), (2, None, "the of 12"), (3, "", "no label"), (4, "Votes", None)],
                                  "id long, title string, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 0), (5, 1)], "id long, label int")
    rows = prepare(labels.join(texts, "id"), "id")
    assert rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1
    assert sorted(map(tuple, rows.collect())) == [("1", "council vote budget", 1), ("4", "vote", 0)]


@pytest.fixture(scope="module")
def many_labels(spark, tmp_path_factory):
    """A folder with more labelled rows than the sample of a quick run has."""
    sf, n = str(tmp_path_factory.mktemp("many")), training.QUICK.sample_size + 60
    ids = spark.range(n).withColumnRenamed("id", "doc_id")
    pool = F.when(F.col("doc_id") % 3 == 0, F.lit("miracle secret")).otherwise("council budget")
    ids.withColumn("text", F.concat(pool, F.lit("\nword"), (F.col("doc_id") % 7).cast("string"))).write.parquet(f"{sf}/documents.parquet")
    ids.withColumn("quality", (F.col("doc_id") % 3 > 0).cast("int")).write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "https://e.org/1", "<p>council budget of the secret miracle</p>")], "page_id int, url string, html string").write.parquet(
        f"{sf}/pages.parquet")
    return sf, n


def trained_on(sf):
    return {settings.sample_size for _, folder, settings in model_checks._trained if folder == sf}


def test_model_queries_train_on_every_labelled_row(spark, many_labels, monkeypatch):
    sf, n = many_labels
    monkeypatch.setattr(training, "QUICK_WHOLE", replace(training.QUICK_WHOLE, folds=2, max_iter=3))  # short fits, of all rows
    support = {r["class"]: r.support for r in model_checks.model_report_support(spark, sf).collect()}
    zeros = -(-n // 3)
    assert support == {"0": round(zeros * 0.2), "1": round((n - zeros) * 0.2)}
    assert model_checks.model_report_facts(spark, sf).filter("in_bounds").count() == 2
    assert model_checks.model_report(spark, sf).filter("class = 'accuracy'").first().support == sum(support.values())
    assert model_checks.model_majority(spark, sf).first().majority_share == pytest.approx(support["1"] / sum(support.values()), abs=1e-6)
    assert model_checks.page_scores(spark, sf).count() == 1
    assert trained_on(sf) == {None}
