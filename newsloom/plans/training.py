"""Training and evaluation of the credibility classifier."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace
from statistics import mean, pstdev

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import preview
from ..operators import features, metrics, splits


@dataclass(frozen=True)
class TrainSettings:
    max_features: int = features.FULL_FEATURES
    folds: int = 5
    sample_size: int | None = None
    test_size: float = 0.2
    seed: int = 42
    max_iter: int = 1000
    tol: float = 1e-4


FULL = TrainSettings()
QUICK = TrainSettings(max_features=features.QUICK_FEATURES, folds=3, sample_size=10_000)
# features and folds of a quick run, on every labelled row
QUICK_WHOLE = replace(QUICK, sample_size=None)


@dataclass(frozen=True)
class TrainResult:
    """``split`` holds (doc_id, label, is_test, fold); it is kept with the model."""
    model: PipelineModel
    accuracy: float
    cv_mean: float
    cv_std: float
    split: DataFrame
    majority_share: float


def assign_split(corpus: DataFrame, settings: TrainSettings) -> DataFrame:
    """Hold-out and folds on narrow rows; folds number the training part only."""
    ids = corpus.select("doc_id", "label")
    if settings.sample_size:
        ids = splits.seeded_sample(ids, "doc_id", settings.sample_size, settings.seed)
    split = splits.stratified_split(ids, "doc_id", test_size=settings.test_size, seed=settings.seed)
    train = splits.stratified_folds(split.filter(~F.col("is_test")), "doc_id", settings.folds,
                                    seed=settings.seed)
    test = split.filter("is_test").withColumn("fold", F.lit(None).cast("int"))
    return train.select("doc_id", "label", "is_test", "fold").unionByName(
        test.select("doc_id", "label", "is_test", "fold"))


def train(corpus: DataFrame, work_path: str, settings: TrainSettings = FULL) -> TrainResult:
    """Fit on the training part, score on the hold-out, cross-validate.

    ``corpus`` is ``(doc_id, processed_text, label)`` read from a stored table.  The
    split is written first and everything reads it from there: evaluation later sees
    the same rows, and no fit depends on a lineage back to the raw texts.
    """
    spark = corpus.sparkSession
    assign_split(corpus, settings).write.mode("overwrite").parquet(f"{work_path}/split")
    split = spark.read.parquet(f"{work_path}/split")
    rows = corpus.select("doc_id", "processed_text").join(split, "doc_id")
    rows.write.mode("overwrite").parquet(f"{work_path}/rows")
    rows = spark.read.parquet(f"{work_path}/rows")
    training = rows.filter(~F.col("is_test"))
    classifier = features.CredibilityClassifier(
        max_features=settings.max_features, max_iter=settings.max_iter, tol=settings.tol)
    vocabularies = classifier.fold_vocabularies(training, settings.folds)
    scores = fold_scores(classifier, training, settings.folds, vocabularies)
    model = classifier.fit_with(training, *vocabularies[None])
    line = predict(model, rows.filter("is_test")).agg(
        F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"),
        F.avg(F.col("label").cast("double")).alias("ones")).first()
    return TrainResult(model, line.accuracy, mean(scores), pstdev(scores), split,
                       max(line.ones, 1 - line.ones))


def fold_scores(classifier, training: DataFrame, folds: int, vocabularies=None) -> list[float]:
    """Accuracy on every fold of a model fitted on the others, vocabulary included.

    Terms are counted for all folds at once (``vocabularies``); what a fold's model is trained on has the
    sums less its own.  The folds are a stored column, so each fit is a filtered scan, and the fits are submitted
    side by side.
    """
    vocabularies = vocabularies or classifier.fold_vocabularies(training, folds)

    def score(fold: int) -> float:
        terms, size = vocabularies[fold]
        model = classifier.fit_with(training.filter(F.col("fold") != fold), terms, size)
        scored = predict(model, training.filter(F.col("fold") == fold))
        return metrics.accuracy(scored).first().accuracy

    with ThreadPoolExecutor(folds) as pool:
        return list(pool.map(score, range(folds)))


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with ``prediction`` (int) and ``confidence``."""
    scored = model.transform(rows)
    probability = vector_to_array("probability")
    return scored.select(*rows.columns, F.col("prediction").cast("int").alias("prediction"),
                         F.array_max(probability).alias("confidence"))


def evaluate(model: PipelineModel, corpus: DataFrame, split: DataFrame,
             seed: int = 42) -> dict[str, DataFrame]:
    """Report on the stored hold-out: accuracy, matrix, report, ten sample rows."""
    test = corpus.select("doc_id", "processed_text").join(
        split.filter("is_test").select("doc_id", "label"), "doc_id")
    scored = predict(model, test)
    return {"accuracy": metrics.accuracy(scored),
            "confusion_matrix": metrics.confusion_matrix(scored),
            "classification_report": metrics.classification_report(scored),
            "sample_predictions": sample_predictions(scored, seed)}


def sample_predictions(scored: DataFrame, seed: int = 42, size: int = 10) -> DataFrame:
    return (scored.orderBy(splits.seeded_hash("doc_id", seed), "doc_id").limit(size)
            .select("doc_id", preview("processed_text", 200).alias("text"),
                    F.col("label").alias("actual"), F.col("prediction").alias("predicted"), "confidence"))


def save(result: TrainResult, path: str, settings: TrainSettings, cache_path: str | None = None) -> None:
    """Model, split and one row of facts about the run, which is also added to the table of runs.

    ``cache_path`` is where the prepared corpus lies that the model was trained on.
    """
    spark = result.split.sparkSession
    result.model.write().overwrite().save(f"{path}/model")
    result.split.write.mode("overwrite").parquet(f"{path}/model_split")
    facts = {"model_type": "logistic_regression", "features": "title + text (preprocessed)",
             "vectorizer": "TF-IDF over words and pairs", "accuracy": result.accuracy,
             "cv_mean": result.cv_mean, "cv_std": result.cv_std,
             "majority_share": result.majority_share, "settings": json.dumps(asdict(settings)),
             "cache_path": cache_path}
    row = spark.createDataFrame([facts], _FACTS).coalesce(1)
    row.write.mode("overwrite").json(f"{path}/metadata", ignoreNullFields=False)
    row.withColumn("saved_at", F.current_timestamp()).write.mode("append").parquet(f"{path}/runs")


_FACTS = ("model_type string, features string, vectorizer string, accuracy double, cv_mean double, cv_std double, "
          "majority_share double, settings string, cache_path string")


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Facts of every run that was saved at ``path``."""
    return spark.read.schema(f"{_FACTS}, saved_at timestamp").parquet(f"{path}/runs")


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """``(model, metadata, split)``."""
    return (PipelineModel.load(f"{path}/model"),
            spark.read.schema(_FACTS).json(f"{path}/metadata"), spark.read.parquet(f"{path}/model_split"))
