"""Quality figures of predictions; all are aggregates over a prediction table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Wording of the interpretation.
HIGH = {"Fake": "High confidence: This appears to be FAKE news",
        "Real": "High confidence: This appears to be REAL news"}
MODERATE = {"Fake": "Moderate confidence: This likely appears to be FAKE news",
            "Real": "Moderate confidence: This likely appears to be REAL news"}
LOW = "Low confidence: Uncertain classification - manual review recommended"


def class_name(prediction) -> Column:
    return F.when(F.col(prediction) == 1, "Real").otherwise("Fake")


def interpretation(name, confidence) -> Column:
    """Both bounds are strict."""
    name, confidence = F.col(name), F.col(confidence)

    def worded(texts):
        return F.when(name == "Fake", texts["Fake"]).otherwise(texts["Real"])

    return (F.when(confidence > 0.8, worded(HIGH)).when(confidence > 0.6, worded(MODERATE))
            .when(confidence.isNotNull(), LOW))


def accuracy(df: DataFrame) -> DataFrame:
    return df.agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))


def confusion_matrix(df: DataFrame, classes: tuple[int, ...] = (0, 1)) -> DataFrame:
    """Actual class by predicted class, zeros kept."""
    counts = df.groupBy("label").agg(*[
        F.count_if(F.col("prediction") == c).alias(f"predicted_{c}") for c in classes])
    actual = df.sparkSession.createDataFrame([(c,) for c in classes], "label int")
    return actual.join(counts.withColumn("label", F.col("label").cast("int")), "label", "left").na.fill(0)


def classification_report(df: DataFrame, classes: tuple[int, ...] = (0, 1)) -> DataFrame:
    """``(class, precision, recall, f1, support)`` per class and for the averages.

    One aggregate row feeds all lines; an undefined ratio counts as 0.
    """
    label, guess = F.col("label"), F.col("prediction")
    sums = [F.count("*").alias("n"), F.count_if(label == guess).alias("right")]
    for c in classes:
        sums += [F.count_if((label == c) & (guess == c)).alias(f"tp_{c}"),
                 F.count_if(label == c).alias(f"actual_{c}"),
                 F.count_if(guess == c).alias(f"guessed_{c}")]
    row = df.agg(*sums)

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    def line(name, p, r, f, support):
        return F.struct(F.lit(name).alias("class"), F.round(p, 4).alias("precision"),
                        F.round(r, 4).alias("recall"), F.round(f, 4).alias("f1"),
                        support.cast("long").alias("support"))

    figures = {}
    for c in classes:
        p = ratio(F.col(f"tp_{c}"), F.col(f"guessed_{c}"))
        r = ratio(F.col(f"tp_{c}"), F.col(f"actual_{c}"))
        figures[c] = (p, r, ratio(2 * p * r, p + r), F.col(f"actual_{c}"))
    lines = [line(str(c), *figures[c]) for c in classes]
    total = F.col("n")
    macro = [sum(figures[c][i] for c in classes) / len(classes) for i in range(3)]
    weighted = [ratio(sum(figures[c][i] * figures[c][3] for c in classes), total) for i in range(3)]
    acc = ratio(F.col("right"), total)
    lines += [line("accuracy", acc, acc, acc, total), line("macro avg", *macro, total),
              line("weighted avg", *weighted, total)]
    return row.select(F.explode(F.array(*lines)).alias("x")).select("x.*")


def cv_summary(fold_scores: DataFrame, score: str = "accuracy") -> DataFrame:
    """Mean, population deviation and the printed plus-minus of fold scores."""
    return fold_scores.agg(
        F.round(F.avg(score), 4).alias("cv_mean"),
        F.round(F.stddev_pop(score), 4).alias("cv_std"),
        F.round(F.stddev_pop(score) * 2, 4).alias("cv_plus_minus"))


def fold_accuracy(df: DataFrame) -> DataFrame:
    return df.groupBy("fold").agg(
        F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))


def batch_summary(scores: DataFrame) -> DataFrame:
    """Totals and shares of scored rows; ``prediction`` is a name or null for an error."""
    fake, real = F.count_if(F.col("prediction") == "Fake"), F.count_if(F.col("prediction") == "Real")
    ok = F.count("prediction")

    def share(n):
        return F.round(F.coalesce(F.try_divide(n, ok) * 100, F.lit(0.0)), 4)

    return scores.agg(
        F.count("*").alias("total_texts"), ok.alias("successful_predictions"),
        fake.alias("fake_count"), real.alias("real_count"),
        (F.count("*") - ok).alias("error_count"),
        share(fake).alias("fake_percentage"), share(real).alias("real_percentage"))
