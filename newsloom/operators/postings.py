"""Postings: which term stands where.

The table is the search index as plain rows.  Every row repeats what ranking and
filtering need (field length, publish time, category, source), so a query touches
the rows of its own terms and no table of all articles.

Layout on disk: partitions ``field`` / ``term_bucket``, inside them files by articles.  While a
layout has few folders, articles are dealt over tasks by their bytes and every task writes a file per
folder, so no posting is shuffled; with many folders these files would be tiny, and postings are dealt by
bucket and by a salt of the article, finer than the layout names where there are more tasks.  Either way a
term held by a third of all articles is spread, and no task holds it whole, neither when it is written nor when it is read.

The postings of a term are cut into blocks by ``impact``, a class of how much a term weighs in
the default fields of an article; all rows of a term and an article are in one block.  Rows are sorted
by term and block, and the statistics keep a bound of the weight per block, so a search for the best
hits skips the blocks that cannot hold one.  Distinct terms are kept in order and by their
3-grams, for prefixes and wildcards.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import term_places
from ..functions.text import keyword_terms, search_tokens
from ..sources import tables
from .grams import gram_bucket, term_grams

# Parameters of BM25 (Robertson and Zaragoza, 2009).
BM25_B = 0.75
BM25_K1 = 1.2

# How each field is indexed.
STEMMED_FIELDS = ("title", "summary", "content")
PLAIN_FIELDS = ("link", "author")
KEYWORD_FIELDS = ("category", "source", "tags")
DEFAULT_FIELDS = STEMMED_FIELDS

# of the statistics of terms, for each task that makes their 3-grams
TERM_BYTES = 2 << 20
# of the files that articles come from: what one task sorts and writes (its rows are some 40 times as large), and
# what is worth a task of its own
TASK_BYTES, LEAST_BYTES = 12 << 20, 1 << 20
# a task writes a file for each of so many folders (of about 128 KB); for more, postings are shuffled by folder
OWN_FOLDERS = 128

# of blocks: how finely the weight in each default field is cut, and a typical length of the field
_CLASSES = 6
_TYPICAL_LENGTH = {"title": 10, "summary": 50, "content": 400}


@dataclass(frozen=True)
class IndexLayout:
    """How postings are spread.

    A build can use up to fields x term_buckets x salts tasks.  Choose it once per index,
    with :meth:`for_bytes` for anything large; queries need the same ``term_buckets``.
    """
    term_buckets: int = 64
    salts: int = 4

    @classmethod
    def for_bytes(cls, text_bytes: int, task_bytes: int = 256 << 20) -> IndexLayout:
        """Layout for a corpus of ``text_bytes``: about ``task_bytes`` of text per task.

        Buckets grow first (a query reads one bucket per term), up to 4096 folders per
        field; salts take what is left.
        """
        tasks = max(1, -(-text_bytes // task_bytes))
        buckets = min(4096, max(16, tasks))
        return cls(buckets, max(1, -(-tasks // buckets)))


@dataclass(frozen=True)
class SearchIndex:
    """Three tables, written or lazy, and of a written one its folder.

    ``look_up`` of a lazy index makes the postings of given terms without the others.
    """
    postings: DataFrame
    term_stats: DataFrame
    field_stats: DataFrame
    layout: IndexLayout = IndexLayout()
    stem: bool = True
    look_up: Callable[[list[str], tuple[str, ...]], DataFrame] | None = None
    path: str | None = None


def term_bucket(term: str, layout: IndexLayout) -> int:
    """Bucket of a query term; the same function as the column in the table."""
    return zlib.crc32(term.encode()) % layout.term_buckets


def bucket_column(layout: IndexLayout) -> Column:
    return F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(layout.term_buckets)).cast("int")


def article_salt(layout: IndexLayout) -> Column:
    return F.pmod(F.xxhash64("article_id"), F.lit(layout.salts)).cast("int")


def _field_tokens(field: str, keyword_mode: str) -> Column:
    if field == "tags":
        low = F.transform("tags", lambda t: F.lower(F.trim(t)))
        tags = F.array_distinct(F.filter(low, lambda t: t != ""))
        return F.coalesce(tags, F.array().cast("array<string>"))
    if field in KEYWORD_FIELDS:
        return keyword_terms(field, keyword_mode)
    return search_tokens(field)


def field_lengths(articles: DataFrame, fields: tuple[str, ...] = DEFAULT_FIELDS, keyword_mode: str = "value") -> DataFrame:
    """One row per article and field: ``field_length``.  Stemming maps tokens one to one, so lengths need no stems."""
    per_field = [F.struct(F.lit(f).alias("field"), F.size(_field_tokens(f, keyword_mode)).alias("field_length")) for f in fields]
    return articles.select("article_id", F.explode(F.array(*per_field)).alias("f")).select("article_id", "f.*")


def _impact(fields: tuple[str, ...]):
    """Part of a posting in the number of its block: a class of its weight, in the place of its field."""
    places = [DEFAULT_FIELDS.index(f) if f in DEFAULT_FIELDS else -1 for f in fields]
    factor = np.array([(_CLASSES + 1) ** p if p >= 0 else 0 for p in places], np.int64)
    typical = np.array([_TYPICAL_LENGTH.get(f, 1) for f in fields], np.int64)

    def part(field, tf, length):
        weight = tf / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / typical[field]))
        return (np.minimum(np.floor(weight * _CLASSES), _CLASSES - 1) + 1) * factor[field]

    return part


_GIVEN = ("article_id", "published", "category", "source")


def build_postings(articles: DataFrame, fields: tuple[str, ...] = DEFAULT_FIELDS, stem: bool = True,
                   layout: IndexLayout = IndexLayout(), keyword_mode: str = "value",
                   only_terms: list[str] | None = None, in_order: bool = False) -> DataFrame:
    """``(field, term, article_id, tf, positions, ...)``, one row per term of a field.

    A narrow step.  An article is one row, so its terms are grouped where the row is, by blocks of
    articles in Arrow batches (:mod:`newsloom.functions.term_places`); each distinct word of a block
    is stemmed once.  No token ever crosses a shuffle.  ``only_terms`` leaves out all others before the sort.
    ``in_order`` gives the rows of a block in the order of a written index, for a sort that merges blocks.
    """
    fields = tuple(fields)
    rows = articles.select(*_GIVEN, *[_field_tokens(f, keyword_mode).alias(f"t_{i}") for i, f in enumerate(fields)])
    places = list(range(len(_GIVEN), len(_GIVEN) + len(fields)))
    stemmed = [stem and f in STEMMED_FIELDS for f in fields]
    part = _impact(fields)

    def group(batches):
        made, names = term_places.Postings(stemmed, only_terms, part), pa.array(fields, pa.string())
        for batch in batches:
            for block in term_places.blocks(batch, places):
                own = made.of_block([block.column(i) for i in places])
                if in_order:
                    order = term_places.sorted_rows(own, list(fields), layout.term_buckets)
                    own = {name: own[name][order] if isinstance(own[name], np.ndarray) else own[name].take(pa.array(order))
                           for name in ("row", "field", "term", "tf", "positions", "field_length", "impact")}
                row = pa.array(own["row"])
                given = [block.column(i).take(row) for i in range(len(_GIVEN))]
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(own["field"])), own["term"], given[0], pa.array(own["tf"]), own["positions"],
                     pa.array(own["field_length"]), *given[1:], pa.array(own["impact"])], names=_POSTING)

    kinds = {name: rows.schema[name].dataType.simpleString() for name in _GIVEN}
    schema = (f"field string, term string, article_id {kinds['article_id']}, tf int, positions array<int>, field_length int, "
              f"published {kinds['published']}, category {kinds['category']}, source {kinds['source']}, impact int")
    return (rows.mapInArrow(group, schema)
            .withColumn("term_bucket", bucket_column(layout)).withColumn("salt", article_salt(layout)))


_POSTING = ["field", "term", "article_id", "tf", "positions", "field_length", "published", "category", "source", "impact"]


def spread_salt(spark: SparkSession, layout: IndexLayout) -> Column:
    """The salt of an article, made finer where there are more tasks than the layout names."""
    return F.pmod(F.xxhash64("article_id"), F.lit(layout.salts * tables.pieces(spark, layout.term_buckets * layout.salts)))


def dealt_articles(articles: DataFrame) -> DataFrame:
    """Articles dealt by id over as many tasks as the bytes of their files ask for; a few megabytes stay where they are."""
    size = tables.input_bytes(articles)
    if size <= LEAST_BYTES:
        return articles
    return articles.repartition(tables.tasks_for(articles.sparkSession, size, TASK_BYTES, LEAST_BYTES), "article_id")


def term_statistics(postings: DataFrame) -> DataFrame:
    """Document frequency and total frequency; additive over batches of articles."""
    return postings.groupBy("field", "term_bucket", "term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("cf"))


def field_statistics(articles: DataFrame, fields: tuple[str, ...] = DEFAULT_FIELDS,
                     keyword_mode: str = "value") -> DataFrame:
    """Articles and total length per field; additive over batches."""
    return (field_lengths(articles, fields, keyword_mode).groupBy("field")
            .agg(F.count("*").alias("n_articles"), F.sum("field_length").alias("total_length")))


def index_articles(articles: DataFrame, fields: tuple[str, ...] = DEFAULT_FIELDS, stem: bool = True,
                   layout: IndexLayout = IndexLayout(), keyword_mode: str = "value") -> SearchIndex:
    """The index of distinct articles as lazy tables."""
    def look_up(terms, wanted):
        return build_postings(articles, wanted, stem, layout, keyword_mode, terms)

    postings = build_postings(articles, fields, stem, layout, keyword_mode)
    return SearchIndex(postings, term_statistics(postings),
                       field_statistics(articles, fields, keyword_mode), layout, stem, look_up)


def _settings(layout: IndexLayout, stem: bool, fields: tuple[str, ...], keyword_mode: str, published: str) -> dict:
    return {"term_buckets": layout.term_buckets, "salts": layout.salts, "stem": stem, "fields": list(fields),
            "keyword_mode": keyword_mode, "published_type": published}


_SETTINGS = ("term_buckets int, salts int, stem boolean, fields array<string>, keyword_mode string, "
             "published_type string")


def keep_settings(spark: SparkSession, path: str, settings: dict) -> None:
    """Store how an index is made beside it; a batch made in another way is refused."""
    known = stored_settings(spark, path)
    if known is None:
        row = tuple(settings[name] for name in _SETTINGS_NAMES)
        spark.createDataFrame([row], _SETTINGS).coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")
    elif known != settings:
        raise ValueError(f"the index is made with {known}, not with {settings}")


_SETTINGS_NAMES = tuple(part.split()[0] for part in _SETTINGS.split(", "))


def stored_settings(spark: SparkSession, path: str) -> dict | None:
    if not tables.exists(spark, f"{path}/settings"):
        return None
    return spark.read.schema(_SETTINGS).parquet(f"{path}/settings").first().asDict()


def write_index(articles: DataFrame, path: str, batch_id: int = 0,
                fields: tuple[str, ...] = DEFAULT_FIELDS + KEYWORD_FIELDS + PLAIN_FIELDS,
                stem: bool = True, layout: IndexLayout = IndexLayout(),
                keyword_mode: str = "value", skip_indexed: bool = True) -> int:
    """Append the index of one batch of articles; a replayed batch replaces itself.

    Articles that an earlier batch has indexed are left out (``skip_indexed``; only ids are compared).
    Returns how many the batch has.  The statistics are taken from the written postings, not from a
    second pass over the texts.  Pass stored articles: they are read a second time for the column of
    ids only.
    """
    spark = articles.sparkSession
    keep_settings(spark, path, _settings(layout, stem, fields, keyword_mode,
                                         articles.schema["published"].dataType.simpleString()))
    if skip_indexed:
        articles = not_indexed(articles, path, batch_id)
    if len(fields) * layout.term_buckets <= OWN_FOLDERS:
        postings = build_postings(dealt_articles(articles), fields, stem, layout, keyword_mode, in_order=True).drop("salt")
    else:
        postings = (build_postings(articles, fields, stem, layout, keyword_mode).drop("salt")
                    .repartition("term_bucket", spread_salt(spark, layout)))
    tables.write_batch(postings.sortWithinPartitions("field", "term_bucket", "term", "impact"),
                       f"{path}/postings", batch_id, ("field", "term_bucket"), options=tables.ID_PAGES)
    tables.write_batch(articles.select("article_id"), f"{path}/indexed_ids", batch_id)
    return write_statistics(spark, path, batch_id, fields)


def block_statistics(postings: DataFrame, lengths: DataFrame) -> DataFrame:
    """``(field, term_bucket, term, impact, df, cf, top)`` of written postings.

    ``top`` is the largest share of its limit that the weight of a posting of the block has, at the
    mean length of the field in ``lengths`` (field, mean_length), one row per field.
    """
    norm = BM25_K1 * (1 - BM25_B + BM25_B * F.col("field_length") / F.col("mean_length"))
    return (postings.join(F.broadcast(lengths), "field")
            .groupBy("field", "term_bucket", "term", "impact")
            .agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max(F.col("tf") / (F.col("tf") + norm)).alias("top")))


def write_statistics(spark: SparkSession, path: str, batch_id: int, fields: tuple[str, ...]) -> int:
    """Statistics of one batch, from its written postings and ids; returns the number of articles."""
    batch = F.col("ingest_batch") == batch_id
    written = read_postings(spark, path).filter(batch)
    n = read_ids(spark, path).filter(batch).count()
    lengths = {r.field: r.length for r in written.groupBy("field").agg(F.sum("tf").alias("length")).collect()}  # a row per field
    field_rows = spark.createDataFrame([(f, n, lengths.get(f) or 0) for f in fields],
                                       "field string, n_articles long, total_length long")
    tables.write_batch(field_rows.coalesce(1), f"{path}/field_stats", batch_id)
    means = spark.createDataFrame([(f, lengths[f] / n) for f in fields if lengths.get(f)], "field string, mean_length double")
    buckets = stored_settings(spark, path)["term_buckets"]
    # few rows per distinct term by now, dealt by term over no more tasks than there are
    dealt = F.pmod(F.xxhash64("term"), F.lit(tables.pieces(spark, 2 * buckets * len(fields))))
    stats = block_statistics(written, means).repartition("field", "term_bucket", dealt)
    tables.write_batch(stats.sortWithinPartitions("field", "term_bucket", "term", "impact"),
                       f"{path}/term_stats", batch_id, ("field", "term_bucket"))
    # the distinct terms in order, and by their grams
    terms = read_term_stats(spark, path).filter(batch).select("term").distinct()
    tables.write_batch(terms.repartitionByRange("term").sortWithinPartitions("term"), f"{path}/terms", batch_id)
    size = tables.input_bytes(spark.read.schema("term string").parquet(f"{path}/term_stats/ingest_batch={batch_id}"))
    dealt = read_terms(spark, path).filter(batch).select("term").repartition(
        tables.tasks_for(spark, size, TERM_BYTES, TERM_BYTES >> 3), "term")
    grams = (dealt.select("term", F.explode(term_grams("term")).alias("gram"))
             .withColumn("gram_bucket", gram_bucket(F.col("gram"), buckets)))
    # terms are shuffled, not their grams; every task writes a file per bucket
    tables.write_batch(grams.sortWithinPartitions("gram_bucket", "gram", "term"), f"{path}/term_grams", batch_id, ("gram_bucket",))
    return n


def copy_statistics(spark: SparkSession, path: str, new_path: str, batch_id: int) -> None:
    """Statistics of an index of one batch that is no later than ``batch_id``, for another index with the same postings."""
    parts = ("field", "term_bucket")
    for table, rows, folders, order in (
            ("field_stats", read_field_stats(spark, path).coalesce(1), (), ("field",)),
            ("term_stats", read_term_stats(spark, path), parts, (*parts, "term", "impact")),
            ("terms", read_terms(spark, path), (), ("term",)),
            ("term_grams", read_term_grams(spark, path), ("gram_bucket",), ("gram_bucket", "gram", "term"))):
        own = rows.filter(F.col("ingest_batch") <= batch_id).drop("ingest_batch")
        tables.write_batch(own.sortWithinPartitions(*order), f"{new_path}/{table}", batch_id, folders)


# The stored tables are read with their schemas: nothing is inferred, and a batch may be empty.
def read_postings(spark: SparkSession, path: str) -> DataFrame:
    published = stored_settings(spark, path)["published_type"]
    return spark.read.schema(
        f"term string, article_id string, tf int, positions array<int>, field_length int, published {published}, "
        "category string, source string, impact int, ingest_batch long, field string, term_bucket int").parquet(f"{path}/postings")


def read_term_stats(spark: SparkSession, path: str) -> DataFrame:
    """Frequencies, to be added up over batches and blocks."""
    return spark.read.schema("term string, impact int, df long, cf long, top double, ingest_batch long, field string, "
                             "term_bucket int").parquet(f"{path}/term_stats")


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """Distinct terms of each batch, in order."""
    return spark.read.schema("term string, ingest_batch long").parquet(f"{path}/terms")


def read_term_grams(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term string, gram string, ingest_batch long, gram_bucket int").parquet(f"{path}/term_grams")


def read_field_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("field string, n_articles long, total_length long, ingest_batch long").parquet(
        f"{path}/field_stats")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("article_id string, ingest_batch long").parquet(f"{path}/indexed_ids")


def load_index(spark: SparkSession, path: str, layout: IndexLayout | None = None,
               stem: bool | None = None) -> SearchIndex:
    """A written index; statistics of its batches are added up when they are used.

    How it was made is stored with it; a ``layout`` or ``stem`` that says otherwise is refused.
    """
    known = stored_settings(spark, path)
    if known is None:
        raise ValueError(f"no index at {path}")
    own = IndexLayout(known["term_buckets"], known["salts"])
    if layout not in (None, own) or stem not in (None, known["stem"]):
        raise ValueError(f"the index is made with {known}")
    return SearchIndex(
        read_postings(spark, path).withColumn("salt", article_salt(own)),
        read_term_stats(spark, path), read_field_stats(spark, path), own, known["stem"], path=path)


def not_indexed(articles: DataFrame, index_path: str, before_batch: int | None = None) -> DataFrame:
    """Articles that are not in the index, or in none of its batches before ``before_batch``; only ids are compared."""
    spark = articles.sparkSession
    if not tables.exists(spark, f"{index_path}/indexed_ids"):
        return articles
    known = read_ids(spark, index_path)
    if before_batch is not None:
        known = known.filter(F.col("ingest_batch") < before_batch)
    seen = known.join(articles.select("article_id"), "article_id", "left_semi").select("article_id")
    return articles.join(seen, "article_id", "left_anti")
