"""TF-IDF features: as rows for inspection, as ML stages for training."""

from __future__ import annotations

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (CountVectorizerModel, ElementwiseProduct, NGram, Normalizer,
                                SQLTransformer)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.wordlists import ENGLISH_STOP_WORDS
from ..session import scratch_path

MIN_DF = 2
MAX_DF_SHARE = 0.95
FULL_FEATURES = 10_000
QUICK_FEATURES = 5_000
CELLS = 1 << 20  # of the sums that bound the counts of terms
FIRST_CELLS = 4  # cells counted at first, a wanted term


def _bigrams(words: Column) -> Column:
    following = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    pairs = F.zip_with(words, following, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(pairs, lambda g: g.isNotNull())


def grams(text, stop_words=ENGLISH_STOP_WORDS) -> Column:
    """Words of two letters or more without stop words, followed by their pairs."""
    words = F.regexp_extract_all(F.col(text) if isinstance(text, str) else text,
                                 F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    stop = list(stop_words)
    words = F.filter(words, lambda t: ~t.isin(stop)) if stop else words
    return F.concat(words, _bigrams(words))


def gram_statistics(rows: DataFrame, grams_col: str, folds: int = 0, cells: tuple[DataFrame, int] | None = None) -> DataFrame:
    """``(term, df, total)`` of a column of grams: documents that have a term, and its occurrences.

    One generator gives every document once per distinct term (d) and every occurrence (c); both
    are summed in the map tasks, so what is shuffled is at most one row per term and task.  With
    ``folds``, ``df_0, total_0`` and so on are the shares of the rows' folds.  ``cells``, if given, are
    those (cell) of so many whose terms are counted.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    once = F.transform(F.array_distinct(grams_col), lambda t: F.struct(t.alias("term"), one.alias("d"), none.alias("c")))
    every = F.transform(grams_col, lambda t: F.struct(t.alias("term"), none.alias("d"), one.alias("c")))
    by = ["fold"] if folds else []
    occurring = rows.select(*by, F.explode(F.concat(once, every)).alias("x")).select(*by, "x.*")
    if cells is not None:
        wanted, number = cells
        occurring = occurring.withColumn("cell", _cell("term", number)).join(F.broadcast(wanted.select("cell")), "cell", "left_semi")
    return occurring.groupBy("term").agg(F.sum("d").alias("df"), F.sum("c").alias("total"), *[
        F.sum(F.when(F.col("fold") == i, F.col(c)).otherwise(0)).alias(f"{name}_{i}")
        for i in range(folds) for c, name in (("d", "df"), ("c", "total"))])


def without_fold(statistics: DataFrame, fold: int | None) -> DataFrame:
    """``(term, df, total)`` of all folds but one: all counts less the fold's own."""
    if fold is None:
        return statistics.select("term", "df", "total")
    return statistics.select("term", *[(F.col(c) - F.col(f"{c}_{fold}")).alias(c) for c in ("df", "total")])


def vocabulary(statistics: DataFrame, n_docs, max_features: int = FULL_FEATURES,
               min_df: int = MIN_DF, max_df: float = MAX_DF_SHARE) -> DataFrame:
    """``(term, df, total)`` of the most frequent terms; ties go by term.

    At most ``max_features`` rows, so later steps may broadcast it.
    """
    return (statistics.filter((F.col("df") >= min_df) & (F.col("df") <= n_docs * F.lit(max_df)))
            .orderBy(F.col("total").desc(), F.col("term")).limit(max_features))


def _cell(term, cells: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(cells)).cast("int")


def cell_sums(rows: DataFrame, grams_col: str, folds: int = 0, cells: int = CELLS) -> DataFrame:
    """``(cell, total)``: occurrences of all terms that a hash puts in the cell, so of none of them more.

    Sums of batches add up.  At most ``cells`` rows are shuffled per task, however many terms there are.
    With ``folds`` there are ``total_0`` and so on, the shares of the rows' folds.
    """
    by = ["fold"] if folds else []
    placed = rows.select(*by, F.explode(F.transform(grams_col, lambda t: _cell(t, cells))).alias("cell"))
    return placed.groupBy("cell").agg(F.count("*").alias("total"), *[
        F.count_if(F.col("fold") == i).alias(f"total_{i}") for i in range(folds)])


def frequent_statistics(rows: DataFrame, grams_col: str, sizes: dict[int | None, int], max_features: int = FULL_FEATURES,
                        min_df: int = MIN_DF, max_df: float = MAX_DF_SHARE, cells: int = CELLS) -> DataFrame:
    """:func:`gram_statistics` of fewer terms, among them the whole :func:`vocabulary` of each of several corpora.

    ``sizes`` names the corpora and their numbers of rows: None is all rows, a number all rows but those of
    that fold.  Terms of the heaviest cells are counted first.  The last of the ``max_features`` best of them
    sets a floor for each corpus, and a cell whose sum is below it holds no better term.  Where all cells
    from the floor on are counted, the vocabulary is proven whole; the others of them are counted too,
    and then it is, as a floor only rises.  Where the first cells have fewer terms than wanted, every cell that
    may hold a term of ``min_df`` documents is counted.  What is broadcast is bounded by ``cells``.
    """
    spark = rows.sparkSession
    folds = 1 + max((f for f in sizes if f is not None), default=-1)

    def kept(df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(spark, label)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    sums = kept(cell_sums(rows, grams_col, folds, cells).filter(F.col("total") >= min_df), "cell-sums")
    first = kept(sums.orderBy(F.col("total").desc(), "cell").limit(FIRST_CELLS * max_features).select("cell"), "first-cells")
    statistics = kept(gram_statistics(rows, grams_col, folds, (first, cells)), "first-terms")
    may_hold = F.lit(False)
    for fold, size in sizes.items():
        best = vocabulary(without_fold(statistics, fold), F.lit(size), max_features, min_df, max_df)
        line = best.agg(F.count("*").alias("n"), F.min("total").alias("least")).first()
        sum_ = F.col("total") if fold is None else F.col("total") - F.col(f"total_{fold}")
        may_hold = may_hold | (sum_ >= (line.least if line.n and line.n == max_features else min_df))
    others = kept(sums.filter(may_hold).join(first, "cell", "left_anti").select("cell"), "other-cells")
    if others.isEmpty():
        return statistics
    return statistics.unionByName(kept(gram_statistics(rows, grams_col, folds, (others, cells)), "other-terms"))


def frequent_terms(rows: DataFrame, grams_col: str, n_docs: int, max_features: int = FULL_FEATURES,
                   min_df: int = MIN_DF, max_df: float = MAX_DF_SHARE, cells: int = CELLS) -> DataFrame:
    """The rows of :func:`vocabulary`, without counting the terms that cannot be among them."""
    statistics = frequent_statistics(rows, grams_col, {None: n_docs}, max_features, min_df, max_df, cells)
    return vocabulary(statistics, F.lit(n_docs), max_features, min_df, max_df)


def tfidf_rows(docs: DataFrame, doc_id: str, text: str, max_features: int = FULL_FEATURES,
               stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    """``(doc, term, weight)``: tf * (ln((1+n)/(1+df)) + 1), unit length per document.

    Terms are counted inside their document's row.  The vocabulary is bounded by ``max_features`` and
    is broadcast; the only shuffle of rows is by document, of its vocabulary terms, for the length.
    """
    rows = docs.select(F.col(doc_id).alias("doc"), F.array_sort(grams(text, stop_words)).alias("grams"))
    n = docs.count()
    vocab = vocabulary(gram_statistics(rows, "grams"), F.lit(n), max_features)
    # stretches of equal terms in the sorted array
    places = F.sequence(F.lit(1), F.size("grams"))
    starts = F.when(F.size("grams") > 0, F.filter(places, lambda i: (i == 1) | (
        F.get(F.col("grams"), i - 1) != F.get(F.col("grams"), i - 2)))).otherwise(F.array().cast("array<int>"))
    counted = rows.withColumn("starts", starts).select("doc", F.explode(F.transform("starts", lambda start, k: F.struct(
        F.get(F.col("grams"), start - 1).alias("term"),
        (F.coalesce(F.get(F.col("starts"), k + 1), F.size("grams") + 1) - start).alias("tf")))).alias("x")).select("doc", "x.*")
    weighted = counted.join(F.broadcast(vocab), "term").withColumn(
        "w", F.col("tf") * (F.log(F.lit(1.0 + n) / (F.lit(1.0) + F.col("df"))) + 1))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))
    return weighted.select("doc", "term", F.round(F.col("w") / length, 4).alias("weight"))


class CredibilityClassifier(Estimator):
    """TF-IDF over words and pairs, then L2 logistic regression.

    Vocabulary and document frequencies are counted after a screen by :func:`cell_sums`; the result
    is a pipeline of stock stages, so it is saved, loaded and applied like any other.
    Being one estimator, all of it is fitted anew in every fold.  The penalty is
    1/rows: the loss of the definition is a sum over rows, Spark's is a mean.
    """

    def __init__(self, text_col: str = "processed_text", label_col: str = "label",
                 max_features: int = FULL_FEATURES, max_iter: int = 1000, tol: float = 1e-4,
                 stop_words=ENGLISH_STOP_WORDS, partitions: int | None = None):
        super().__init__()
        self.text_col, self.label_col = text_col, label_col
        self.max_features, self.max_iter, self.tol = max_features, max_iter, tol
        self.stop_words, self.partitions = tuple(stop_words), partitions

    def copy(self, extra=None):
        return CredibilityClassifier(self.text_col, self.label_col, self.max_features,
                                     self.max_iter, self.tol, self.stop_words, self.partitions)

    def _text_stages(self):
        stop = ", ".join("'" + w.replace("'", "\\'") + "'" for w in self.stop_words) or "''"
        words = SQLTransformer(statement=(
            f"SELECT *, filter(regexp_extract_all({self.text_col}, '(?U)\\\\b\\\\w\\\\w+\\\\b', 0), "
            f"t -> t NOT IN ({stop})) AS nl_words FROM __THIS__"))
        pairs = NGram(n=2, inputCol="nl_words", outputCol="nl_pairs")
        both = SQLTransformer(statement="SELECT *, concat(nl_words, nl_pairs) AS nl_grams FROM __THIS__")
        return [words, pairs, both]

    def _chosen(self, statistics: DataFrame, size: int) -> list:
        """Rows (term, idf) of the vocabulary, ``max_features`` at most."""
        idf = F.log((F.lit(1.0) + F.lit(size)) / (F.lit(1.0) + F.col("df"))) + 1
        return vocabulary(statistics, F.lit(size), self.max_features).select("term", idf.alias("idf")).collect()

    def _fit(self, dataset):
        size = dataset.count()
        return self.fit_with(dataset, *self._vocabularies(dataset, {None: size})[None])

    def _vocabularies(self, dataset: DataFrame, sizes: dict[int | None, int]) -> dict[int | None, tuple[list, int]]:
        grammed = PipelineModel(self._text_stages()).transform(dataset)
        statistics = frequent_statistics(grammed, "nl_grams", sizes, self.max_features)
        return {fold: (self._chosen(without_fold(statistics, fold), size), size) for fold, size in sizes.items()}

    def fold_vocabularies(self, dataset: DataFrame, folds: int) -> dict[int | None, tuple[list, int]]:
        """For every fold the vocabulary of the others and their number of rows; for None that of all.

        Terms are counted per fold; the counts of the others are all counts less the fold's own.
        """
        rows = {r.fold: r["count"] for r in dataset.groupBy("fold").count().collect()}
        every = sum(rows.values())
        return self._vocabularies(dataset, {None: every} | {i: every - rows.get(i, 0) for i in range(folds)})

    def fit_with(self, dataset: DataFrame, vocab: list, size: int) -> PipelineModel:
        """Fit on ``dataset`` of ``size`` rows with a vocabulary that is known."""
        text = self._text_stages()
        grammed = PipelineModel(text).transform(dataset)
        if not vocab:
            raise ValueError("no term occurs in two documents; nothing to learn from")
        counts = CountVectorizerModel.from_vocabulary([r.term for r in vocab], "nl_grams", "nl_counts")
        weights = ElementwiseProduct(scalingVec=Vectors.dense([r.idf for r in vocab]),
                                     inputCol="nl_counts", outputCol="nl_weights")
        unit = Normalizer(p=2.0, inputCol="nl_weights", outputCol="features")
        vectors = PipelineModel([counts, weights, unit]).transform(grammed)
        regression = LogisticRegression(
            featuresCol="features", labelCol=self.label_col, regParam=1.0 / size, elasticNetParam=0.0,
            standardization=False, maxIter=self.max_iter, tol=self.tol)
        points = vectors.select("features", self.label_col)
        if self.partitions is not None:     # every step of the fit is one job over all partitions
            points = points.coalesce(self.partitions)
        fitted = regression.fit(points)
        return PipelineModel([*text, counts, weights, unit, fitted])
