"""The domain tables, read from the given tables of a data folder.

Every view is a column-pruned projection of one scan, so a query reads only what
it uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table of texts as it is scanned.

    A file of one row group keeps one core busy.  A caller who knows that may name a number of
    partitions in ``spark.newsloom.inputPartitions``; unset, nothing is dealt out anew.
    """
    df = table(spark, sf_dir, name)
    parts = spark.conf.get("spark.newsloom.inputPartitions", None)
    return df.repartition(int(parts), key) if parts else df


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as articles; copies of a text share an article_id."""
    return texts(spark, sf_dir, "documents", "doc_id").selectExpr(
        r"md5(concat(split_part(text, '\n', 1), 'https://example.org/', md5(text))) AS article_id",
        "doc_id",
        r"split_part(text, '\n', 1) AS title",
        "substr(text, 1, 300) AS summary",
        "text AS content",
        "concat('https://example.org/', md5(text)) AS link",
        "timestampadd(MINUTE, cast(doc_id AS int), TIMESTAMP_NTZ'2024-01-01 00:00:00') AS published",
        "source", "lang AS category", "source AS feed_key",
        "concat('Writer ', cast(length(text) % 97 AS string)) AS author",
        "array(lang, source) AS tags",
        "timestampadd(SECOND, cast(doc_id * 7919 % 86400 AS int), TIMESTAMP_NTZ'2024-06-01 00:00:00')"
        " AS created_at")


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        F.min("lang").alias("category")).selectExpr(
        "source AS key", "concat('Feed ', source) AS name",
        "concat('https://', source, '.example.org/rss') AS url", "category",
        "cast(substr(source, 4) AS int) % 5 <> 0 AS active")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS log_id", "concat('src', cast(user_id % 20 AS string)) AS feed_key",
        "ts AS started_at",
        "CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status",
        "cast(floor(value) AS int) AS articles_found",
        "cast(floor(value / 2) AS int) AS articles_new",
        "CASE WHEN event_type = 'error' THEN concat('code ', cast(event_id % 7 AS string)) END"
        " AS error_message")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents", "doc_id").selectExpr(
        "doc_id", r"split_part(text, '\n', 1) AS title", "text")
    return table(spark, sf_dir, "labels").selectExpr("doc_id", "quality AS label").join(docs, "doc_id")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "pages", "page_id").select("page_id", "url", "html")


def pseudo_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed function of the labels; it feeds the metric queries, it is no model."""
    return table(spark, sf_dir, "labels").selectExpr(
        "doc_id", "quality AS label",
        "CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS prediction",
        "cast(0.5 AS double) + cast(doc_id * 37 % 50 AS double) / 100 AS confidence")


def feed_payloads(spark: SparkSession, sf_dir: str, entries_per_payload: int = 20) -> DataFrame:
    """documents as landed RSS payloads, about ``entries_per_payload`` entries each.

    A payload covers a fixed range of doc_id of one source: it cannot have more entries
    than the range has ids, whatever share of all documents the source has.
    """
    def xml(value):
        # what XML cannot carry becomes a blank; what has a meaning is escaped
        value = F.regexp_replace(value, r"[^\t\n\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", " ")
        for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            value = F.replace(value, F.lit(mark), F.lit(entity))
        return value

    def tag(name, value):
        return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))

    docs = articles(spark, sf_dir)
    item = tag("item", F.concat(
        tag("title", xml(F.col("title"))), tag("link", F.col("link")),
        tag("description", xml(F.col("summary"))),
        tag("content:encoded", xml(F.col("content"))),
        tag("pubDate", F.date_format("published", "dd MMM yyyy HH:mm:ss '+0000'")),
        tag("dc:creator", F.col("author")), tag("category", F.col("category"))))
    head = ('<rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/" '
            'xmlns:dc="http://purl.org/dc/elements/1.1/"><channel>')
    return (docs.withColumn("slice", F.expr(f"doc_id div {entries_per_payload * 20}"))
            .groupBy("feed_key", "slice")
            .agg(F.array_join(F.transform(
                F.array_sort(F.collect_list(F.struct("doc_id", item.alias("item")))),
                lambda x: x["item"]), "").alias("items"))
            .select("feed_key",
                    F.expr("timestamp_seconds(1735689600 + slice)").alias("fetched_at"),
                    F.concat(F.lit(head), F.lit("<title>"), F.col("feed_key"), F.lit("</title>"),
                             F.lit("<description>landed</description>"), F.col("items"),
                             F.lit("</channel></rss>")).alias("payload")))
