"""Substring search over stored articles, by lists of 3-grams.

Beside the articles a table says which article holds which 3-gram in its title, summary or content,
in lower case.  A search intersects the lists of the rarest 3-grams of its needle, opens only the buckets
of the articles that are left, and puts the condition itself to their texts, so the result is that of
a scan.  A needle without three literal letters in a row says nothing about 3-grams: all articles
are read then, which :attr:`ContainsPlan.scan` and the log say.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import tables
from .filters import contains_filter
from .grams import gram_bucket, like_pieces, piece_grams, text_grams

TEXT_FIELDS = ("title", "summary", "content")

_log = logging.getLogger(__name__)


@dataclass(frozen=True)
class GramLayout:
    """How lists and articles are spread; chosen once, stored with the table."""
    gram_buckets: int = 64
    salts: int = 4
    id_buckets: int = 256

    @classmethod
    def for_bytes(cls, text_bytes: int, task_bytes: int = 256 << 20) -> GramLayout:
        tasks = max(1, -(-text_bytes // task_bytes))
        buckets = min(4096, max(16, tasks))
        return cls(buckets, max(1, -(-tasks // buckets)), min(16384, max(64, tasks)))


@dataclass(frozen=True)
class ContainsPlan:
    """3-grams of a needle whose lists are intersected, and how many articles the shortest one has."""
    grams: tuple[str, ...]
    at_most: int | None  # None: all articles are read

    @property
    def scan(self) -> bool:
        return self.at_most is None


def _id_bucket(layout: GramLayout) -> Column:
    return F.pmod(F.xxhash64("article_id"), F.lit(layout.id_buckets)).cast("int")


def write_grams(articles: DataFrame, path: str, batch_id: int = 0, layout: GramLayout = GramLayout()) -> None:
    """Append a batch of articles and their 3-grams; a replayed batch replaces itself.

    Articles are stored whole, by bucket of their id, so that a search opens the buckets it needs.
    """
    spark = articles.sparkSession
    known = _layout(spark, path)
    if known is None:
        spark.createDataFrame([(layout.gram_buckets, layout.salts, layout.id_buckets)],
                              "gram_buckets int, salts int, id_buckets int").coalesce(1).write.parquet(f"{path}/layout")
    elif known != layout:
        raise ValueError(f"the table is made with {known}, not with {layout}")
    stored = articles.withColumn("id_bucket", _id_bucket(layout))
    # folders are cut into as many files as there are tasks for, however few the layout names
    part = F.pmod(F.xxhash64("article_id", F.lit(1)), F.lit(tables.pieces(spark, layout.id_buckets)))
    tables.write_batch(stored.repartition("id_bucket", part).sortWithinPartitions("id_bucket", "article_id"), f"{path}/articles",
                       batch_id, ("id_bucket",), looked_up_by="article_id")
    texts = _articles(spark, path, articles.schema).filter(F.col("ingest_batch") == batch_id)
    every = F.array_distinct(F.flatten(F.array(*[F.coalesce(text_grams(f), F.array().cast("array<string>")) for f in TEXT_FIELDS])))
    lists = (texts.select("article_id", F.explode(every).alias("gram"))
             .withColumn("gram_bucket", gram_bucket(F.col("gram"), layout.gram_buckets)))
    salt = F.pmod(F.xxhash64("article_id"), F.lit(layout.salts * tables.pieces(spark, layout.gram_buckets * layout.salts)))
    tables.write_batch(lists.repartition("gram_bucket", salt).sortWithinPartitions("gram_bucket", "gram"), f"{path}/lists",
                       batch_id, ("gram_bucket",), options=tables.ID_PAGES)
    counted = _lists(spark, path).filter(F.col("ingest_batch") == batch_id).groupBy("gram").agg(F.count("*").alias("n"))
    tables.write_batch(counted.repartitionByRange("gram").sortWithinPartitions("gram"), f"{path}/counts", batch_id)


def _layout(spark: SparkSession, path: str) -> GramLayout | None:
    if not tables.exists(spark, f"{path}/layout"):
        return None
    return GramLayout(*spark.read.schema("gram_buckets int, salts int, id_buckets int").parquet(f"{path}/layout").first())


def _articles(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    full = StructType([f for f in schema.fields if f.name not in ("ingest_batch", "id_bucket")])
    return spark.read.schema(full.add("ingest_batch", "long").add("id_bucket", "integer")).parquet(f"{path}/articles")


def _lists(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("article_id string, gram string, ingest_batch long, gram_bucket int").parquet(f"{path}/lists")


def plan_contains(spark: SparkSession, path: str, query: str, escape: bool = False, most: int = 6) -> ContainsPlan:
    """The ``most`` rarest 3-grams of a needle, from the counts of its own 3-grams."""
    # a constant of the plan, lower-cased as the texts are
    low = spark.sql("SELECT lower(q) AS q FROM VALUES (:q) AS t(q)", args={"q": query}).first().q
    pieces = [low] if escape else like_pieces(low)
    needed = piece_grams(pieces)
    if not needed:
        _log.info("all articles are read: %r has no three letters in a row", query)
        return ContainsPlan((), None)
    counts = spark.read.schema("gram string, n long, ingest_batch long").parquet(f"{path}/counts")
    n = {r.gram: r.n for r in counts.filter(F.col("gram").isin(needed)).groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    rarest = sorted(needed, key=lambda g: (n.get(g, 0), g))[:most]
    return ContainsPlan(tuple(rarest), n.get(rarest[0], 0))


def search_contains(spark: SparkSession, path: str, schema: StructType, query: str | None = None, category: str | None = None,
                    source: str | None = None, escape: bool = False, broadcast_rows: int = 200_000) -> DataFrame:
    """Stored articles (with columns of ``schema``) that :func:`contains_filter` keeps.

    The ids are broadcast while the shortest list has at most ``broadcast_rows``; then only the
    buckets of these articles are opened.  Longer lists are joined as their sizes ask for.
    """
    rows = _articles(spark, path, schema)
    plan = plan_contains(spark, path, query, escape) if query else ContainsPlan((), None)
    if not plan.scan:
        layout = _layout(spark, path)
        buckets = [r.b for r in spark.createDataFrame([(g,) for g in plan.grams], "gram string").select(
            gram_bucket(F.col("gram"), layout.gram_buckets).alias("b")).distinct().collect()]
        lists = _lists(spark, path).filter(F.col("gram_bucket").isin(buckets) & F.col("gram").isin(list(plan.grams)))
        held = lists.groupBy("article_id").agg(F.count("*").alias("n")).filter(F.col("n") >= len(plan.grams))
        wanted = held.select("article_id", _id_bucket(layout).alias("id_bucket"))
        if plan.at_most <= broadcast_rows:
            wanted = F.broadcast(wanted)
        rows = rows.join(wanted, ["id_bucket", "article_id"], "left_semi")
    return contains_filter(rows, query, category, source, escape).select(*[f.name for f in schema.fields])
