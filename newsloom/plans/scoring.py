"""Scoring whole tables of texts or pages."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.html import extract_pages
from ..functions.text import combine, preview
from ..operators.metrics import class_name, interpretation
from ..operators.quality import check_texts
from ..sources.requests import from_pages
from .corpus import processed_text

NO_CONTENT = "Text contains no meaningful content after preprocessing"
RESULT_COLUMNS = ("prediction", "confidence", "fake_probability", "real_probability",
                  "reliability_score", "text_length", "processed_text_length",
                  "interpretation", "error")


def score_texts(requests: DataFrame, model: PipelineModel, validate: bool = True) -> DataFrame:
    """One result row per request; a row that cannot be scored keeps its reason.

    ``validate`` refuses blank content even when there is a title.  A narrow job: all
    rows run through the model, the result of refused rows is blanked.
    """
    rows = requests if "error" in requests.columns else requests.withColumn(
        "error", F.lit(None).cast("string"))
    if validate:
        checked = check_texts(rows.withColumnRenamed("error", "earlier"))
        rows = checked.withColumn("error", F.coalesce("earlier", "error")).drop("earlier")
    text = combine("title", "content", trim=True)
    rows = (rows.withColumn("combined", text)
            .withColumn("processed_text", processed_text(F.col("combined")))
            .withColumn("error", F.coalesce(
                "error", F.when(F.col("combined") == "", "No text provided for prediction"),
                F.when(F.coalesce(F.length("processed_text"), F.lit(0)) == 0, NO_CONTENT))))
    scored = model.transform(rows).withColumn("p", vector_to_array("probability"))
    ok = F.col("error").isNull()
    keep = [c for c in requests.columns if c != "error"]
    out = scored.select(
        *keep, "error",
        F.when(ok, class_name("prediction")).alias("prediction"),
        F.when(ok, F.array_max("p")).alias("confidence"),
        F.when(ok, F.get("p", F.lit(0))).alias("fake_probability"),
        F.when(ok, F.get("p", F.lit(1))).alias("real_probability"),
        F.when(ok, F.array_max("p")).alias("reliability_score"),
        F.when(ok, F.length("combined")).alias("text_length"),
        F.when(ok, F.length("processed_text")).alias("processed_text_length"))
    out = out.withColumn("interpretation", F.when(ok, interpretation("prediction", "confidence")))
    return out.select(*keep, *RESULT_COLUMNS)


def score_pages(pages: DataFrame, model: PipelineModel) -> DataFrame:
    """Pages to results with url, title and a preview; unreadable pages are error rows."""
    requests = from_pages(extract_pages(pages))
    scored = score_texts(requests, model, validate=False)
    return scored.select(
        "idx", "url", F.col("title").alias("extracted_title"),
        preview("content", 500).alias("extracted_content_preview"), *RESULT_COLUMNS)
