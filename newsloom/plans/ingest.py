"""One ingest run: landed payloads to articles, index and update log.

The run is one set of table jobs for all feeds; a payload that cannot be read ends as
an error row of its feed and stops nothing.  Everything is written under the batch
id, so a run that is repeated after a failure replaces its own rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..operators import dedupe, known_ids, postings, updates
from ..session import scratch_path
from ..sources import feeds as feed_source
from ..sources import tables
from . import rollups


@dataclass(frozen=True)
class Store:
    """Where the tables live; ``root`` is a folder all executors reach."""
    root: str
    layout: postings.IndexLayout = postings.IndexLayout()
    index_fields: tuple[str, ...] = (postings.DEFAULT_FIELDS + postings.KEYWORD_FIELDS
                                     + postings.PLAIN_FIELDS)
    keep_index: bool = True

    @property
    def articles(self):
        return f"{self.root}/articles"

    @property
    def logs(self):
        return f"{self.root}/update_logs"

    @property
    def index(self):
        return f"{self.root}/index"

    @property
    def known_ids(self):
        return f"{self.root}/known_ids"

    @property
    def rollups(self):
        return f"{self.root}/rollups"


def candidates(parsed: DataFrame, registry: DataFrame) -> DataFrame:
    """Distinct articles of a batch, in the stored form."""
    rows = dedupe.with_article_id(feed_source.entries_to_articles(parsed, registry))
    # the time of storing is the time of fetching, so a repeated run writes equal rows
    rows = rows.withColumn("created_at", F.col("fetched_at")).withColumn("updated_at", F.col("fetched_at"))
    # of equal entries the one of the feed that comes first by name is kept
    return dedupe.first_per_article(rows.select(*[f.name for f in schemas.ARTICLES.fields]),
                                    ("published", "link", "source", "feed_key"))


def feed_results(parsed: DataFrame, stored: DataFrame, registry: DataFrame,
                 indexed: DataFrame | None = None) -> DataFrame:
    """Result per feed: found, added, indexed, status, message, metadata.

    A feed with several payloads in the run fails when any of them fails.  Without an
    index ``articles_indexed`` equals ``articles_added``.
    """
    per_feed = parsed.groupBy("feed_key").agg(
        F.min("fetched_at").alias("started_at"), F.max("fetched_at").alias("updated_at"),
        F.max("error_message").alias("error_message"),
        F.sum(F.coalesce(F.size("entries"), F.lit(0))).cast("int").alias("found"),
        F.max_by(F.struct("feed_title", "feed_description", "feed_updated"),
                 F.struct("fetched_at", "feed_title", "feed_description", "feed_updated")).alias("m"))
    added = stored.groupBy("feed_key").agg(F.count("*").cast("int").alias("added"))
    results = per_feed.join(added, "feed_key", "left")
    if indexed is not None:
        n = indexed.groupBy("feed_key").agg(F.count("*").cast("int").alias("n_indexed"))
        results = results.join(n, "feed_key", "left")
    else:
        results = results.withColumn("n_indexed", F.col("added"))
    names = registry.select(F.col("key").alias("feed_key"), F.col("name").alias("feed_name"))
    failed = F.col("error_message").isNotNull()
    return results.join(names, "feed_key", "left").select(
        "feed_key", F.coalesce("feed_name", "feed_key").alias("feed_name"),
        F.when(failed, "error").otherwise("success").alias("status"),
        F.coalesce("found", F.lit(0)).alias("articles_count"),
        F.coalesce("added", F.lit(0)).alias("articles_added"),
        F.coalesce("n_indexed", F.lit(0)).alias("articles_indexed"),
        "error_message", "started_at", "updated_at",
        F.create_map(F.lit("title"), "m.feed_title", F.lit("description"), "m.feed_description",
                     F.lit("updated"), "m.feed_updated").alias("feed_metadata"))


def log_events(results: DataFrame, batch_id: int) -> DataFrame:
    """The 'running' and the completing event of every feed of a run."""
    run = F.concat(F.lit(f"{batch_id}-"), F.col("feed_key"))
    ok = F.col("status") == "success"

    def event(seq):
        done = seq == 1

        def value(column, kind):
            return (column if done else F.lit(None)).cast(kind)

        return F.struct(
            run.alias("run_id"), F.col("feed_key"), F.col("feed_name"), F.lit(seq).alias("event_seq"),
            F.col("started_at"), value(F.col("updated_at"), "timestamp").alias("completed_at"),
            (F.col("status") if done else F.lit("running")).alias("status"),
            value(F.when(ok, F.col("articles_count")).otherwise(0), "int").alias("articles_found"),
            value(F.col("articles_added"), "int").alias("articles_new"),
            value(F.col("articles_indexed"), "int").alias("articles_indexed"),
            value(F.lit(0), "int").alias("articles_updated"),
            value(F.col("error_message"), "string").alias("error_message"),
            value(F.when(ok, F.col("articles_count")).otherwise(0), "int").alias("feed_entries_count"),
            value(F.when(ok, F.col("feed_metadata")), "map<string,string>").alias("feed_metadata"))

    return results.select(F.explode(F.array(event(0), event(1))).alias("e")).select("e.*")


def append_new(batch: DataFrame, store: Store, batch_id: int) -> int:
    """Append the articles of ``batch`` that are not stored; returns how many.

    Known ids are looked up by filters; a store without them is searched by its articles.  The
    ids and the counts of the batch are kept beside the articles.  They are counted in the written partition, from file footers.  (An observation would
    count while writing, but a session that has observed anything can no longer apply a
    freshly fitted regression: its summary drags the session into the task.)
    """
    spark, path = batch.sparkSession, store.articles
    if not _has_earlier(spark, path, batch_id):
        new = batch
    elif known_ids.exists(spark, store.known_ids):
        new = known_ids.not_known(batch, store.known_ids, batch_id)
    else:
        new = dedupe.not_stored(batch, tables.read_batches(spark, path, schemas.ARTICLES, before_batch=batch_id))
    tables.write_batch(new, path, batch_id, looked_up_by="article_id")
    written = batch_rows(spark, path, batch_id)
    if known_ids.exists(spark, store.known_ids) or batch_id == 0 or not _has_earlier(spark, path, batch_id):
        known_ids.write_ids(written, store.known_ids, batch_id)
    rollups.write(rollups.of_articles(written), store.rollups, batch_id)
    return written.count()


def _has_earlier(spark: SparkSession, path: str, batch_id: int) -> bool:
    """Whether the store has articles from before it kept ids."""
    return not tables.read_batches(spark, path, schemas.ARTICLES, before_batch=batch_id).isEmpty()


def batch_rows(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """Articles of one written batch; only its own folder is listed and opened."""
    full = StructType(list(schemas.ARTICLES.fields)).add("ingest_batch", "long")
    return spark.read.schema(full).option("basePath", path).parquet(f"{path}/ingest_batch={batch_id}")


def ingest_batch(spark: SparkSession, payloads: DataFrame, registry: DataFrame, store: Store,
                 batch_id: int, include_inactive: bool = False) -> dict[str, int]:
    """Run one batch and write articles, index and log under ``batch_id``."""
    registry = tables.kept(registry.select(*[c for c in ("key", "name", "category", "active") if c in registry.columns]), "feeds")
    payloads = updates.active_payloads(payloads, registry, include_inactive)
    parsed = feed_source.parse_payloads(payloads).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        added = append_new(candidates(parsed, registry), store, batch_id)
        stored = batch_rows(spark, store.articles, batch_id)
        indexed = None
        # a replay that ends without articles must empty its index too
        if store.keep_index and (added or tables.exists(spark, f"{store.index}/postings/ingest_batch={batch_id}")):
            postings.write_index(stored, store.index, batch_id, store.index_fields, layout=store.layout)
            indexed = stored
        results = feed_results(parsed, stored, registry, indexed)
        tables.write_batch(log_events(results, batch_id), store.logs, batch_id)
    finally:
        parsed.unpersist()
    return {"articles_added": added, "batch_id": batch_id}


def update_logs(spark: SparkSession, store: Store) -> DataFrame:
    """Update log in its current state: one row per feed and run."""
    return updates.fold_events(tables.read_batches(spark, store.logs, schemas.UPDATE_LOGS))


def refreshed_registry(spark: SparkSession, store: Store, registry: DataFrame) -> DataFrame:
    """The feed registry with status and metadata of the last runs, to be published after a run."""
    logs = update_logs(spark, store)
    return updates.apply_status(registry, updates.latest_status(logs, "run_id"), updates.latest_metadata(logs))


def rewrite(spark: SparkSession, store: Store, new_root: str, through_batch: int,
            articles: Callable[[DataFrame], DataFrame] | None = None,
            logs: Callable[[DataFrame], DataFrame] | None = None,
            counts: Callable[[DataFrame], DataFrame] | None = None, broadcast_rows: int = 500_000) -> Store:
    """A new store with the batches up to ``through_batch`` as one, changed by the given functions.

    Articles are laid out by publish time, so that row groups can be skipped.  The index follows
    the articles: postings and ids of articles that are no more go, and statistics are counted
    anew unless nothing has changed in them.  ``counts`` gives the changes of the kept counts; without it they are those between the
    counts before and the articles after.  The old store stays as it is; later batches go to the returned one.
    The ids of articles that go are broadcast while they are at most ``broadcast_rows``; then no posting
    is shuffled to find out whether it stays.
    """
    new = replace(store, root=new_root)
    past = F.col("ingest_batch") <= through_batch

    def changed(change, rows):
        return rows if change is None else change(rows)

    old = tables.read_batches(spark, store.articles, schemas.ARTICLES).filter(past).drop("ingest_batch")
    tables.write_batch(changed(articles, old).repartitionByRange("published").sortWithinPartitions("published"),
                       new.articles, through_batch, looked_up_by="article_id")
    written = tables.read_batches(spark, new.articles, schemas.ARTICLES)
    known_ids.write_ids(written, new.known_ids, through_batch)
    if tables.exists(spark, store.rollups):
        before = rollups.read(spark, store.rollups, through_batch + 1)
        if counts is not None:
            change = counts(before)
        elif articles is not None:
            change = rollups.difference(rollups.of_articles(written), before)
        else:
            change = before.limit(0)
        rollups.write(before.unionByName(change), new.rollups, through_batch)
    else:
        rollups.write(rollups.of_articles(written), new.rollups, through_batch)
    events = tables.read_batches(spark, store.logs, schemas.UPDATE_LOGS).filter(past).drop("ingest_batch")
    tables.write_batch(changed(logs, events), new.logs, through_batch)
    settings = postings.stored_settings(spark, store.index)
    if settings is not None:
        postings.keep_settings(spark, new.index, settings)
        ids = postings.read_ids(spark, store.index).filter(past)
        alive = _alive(ids, written.select("article_id"), past, broadcast_rows) if articles is not None else (
            lambda rows: rows.filter(past).drop("ingest_batch"))
        layout = postings.IndexLayout(settings["term_buckets"], settings["salts"])
        parts = ("field", "term_bucket")
        rows = alive(postings.read_postings(spark, store.index))
        # the postings of a single batch lie in their folders already; those of several are merged
        batches = ids.select("ingest_batch").distinct().count()
        if batches > 1:
            rows = rows.repartition("term_bucket", postings.spread_salt(spark, layout))
        tables.write_batch(rows.sortWithinPartitions(*parts, "term", "impact"),
                           f"{new.index}/postings", through_batch, parts, options=tables.ID_PAGES)
        tables.write_batch(alive(postings.read_ids(spark, store.index)), f"{new.index}/indexed_ids", through_batch)
        # where one batch keeps all of its articles, what was counted of its postings stays true
        if batches == 1 and postings.read_ids(spark, new.index).count() == ids.count():
            postings.copy_statistics(spark, store.index, new.index, through_batch)
        else:
            postings.write_statistics(spark, new.index, through_batch, tuple(settings["fields"]))
    return new


def _alive(ids: DataFrame, left: DataFrame, past: Column, broadcast_rows: int) -> Callable[[DataFrame], DataFrame]:
    """What leaves out the rows of indexed articles (``ids``) that are not ``left``."""
    spark, path = ids.sparkSession, scratch_path(ids.sparkSession, "gone")
    ids.select("article_id").join(left, "article_id", "left_anti").write.parquet(path)
    gone = spark.read.schema("article_id string").parquet(path)
    n = gone.count()

    def alive(rows):
        rows = rows.filter(past).drop("ingest_batch")
        if n > broadcast_rows:
            return rows.join(left, "article_id", "left_semi")
        return rows.join(F.broadcast(gone), "article_id", "left_anti") if n else rows

    return alive


def compact(spark: SparkSession, store: Store, new_root: str, through_batch: int) -> Store:
    """Merge the many small files of past batches into a new store."""
    return rewrite(spark, store, new_root, through_batch)
