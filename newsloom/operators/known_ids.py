"""Which articles are stored already, without reading all ids.

Ids are kept in folders by batch and prefix of the id.  Beside them stands one Bloom filter per batch
and prefix: a fixed number of bits, kept as the 64-bit cells that are not empty.  A new batch looks
its ids up in the cells; only folders that may hold one of them are opened, and there the
ids themselves are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables

PREFIXES = 16
_CELLS = 1 << 18  # of a filter: 2**24 bits, enough for a million ids of one prefix and batch
_PROBES = 2


def _prefix() -> Column:
    return F.pmod(F.xxhash64("article_id"), F.lit(PREFIXES)).cast("int")


def _probes() -> Column:
    """The cells and bits of an id."""
    places = [F.xxhash64("article_id", F.lit(seed)) for seed in range(1, _PROBES + 1)]
    return F.array(*[F.struct(F.pmod(p, F.lit(_CELLS)).cast("int").alias("cell"),
                              F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(p, 40).bitwiseAND(63).cast("int"))
                              .alias("bit")) for p in places])


def write_ids(ids: DataFrame, path: str, batch_id: int) -> None:
    """Keep the ids (article_id) of a batch and their filters; a replayed batch replaces itself."""
    rows = ids.select("article_id").withColumn("id_prefix", _prefix())
    tables.write_batch(rows.repartition("id_prefix").sortWithinPartitions("id_prefix", "article_id"), f"{path}/ids", batch_id,
                       ("id_prefix",))
    cells = (rows.select("id_prefix", F.explode(_probes()).alias("p")).groupBy("id_prefix", "p.cell")
             .agg(F.bit_or("p.bit").alias("bits")))
    tables.write_batch(cells.repartition("id_prefix").sortWithinPartitions("id_prefix", "cell"), f"{path}/filters", batch_id)


def _read(spark: SparkSession, path: str, table: str, schema: str, before_batch: int | None) -> DataFrame:
    rows = spark.read.schema(f"{schema}, ingest_batch long").parquet(f"{path}/{table}")
    return rows if before_batch is None else rows.filter(F.col("ingest_batch") < before_batch)


def exists(spark: SparkSession, path: str) -> bool:
    return tables.exists(spark, f"{path}/ids")


def may_be_known(ids: DataFrame, path: str, before_batch: int | None = None) -> DataFrame:
    """``(article_id, id_prefix, ingest_batch)``: folders that may hold an id."""
    filters = _read(ids.sparkSession, path, "filters", "id_prefix int, cell int, bits long", before_batch)
    asked = ids.select("article_id", _prefix().alias("id_prefix"), F.explode(_probes()).alias("p")).select(
        "article_id", "id_prefix", "p.cell", "p.bit")
    hits = asked.join(filters, ["id_prefix", "cell"]).filter(F.col("bits").bitwiseAND(F.col("bit")) != 0)
    # two probes of an id may be one and the same bit
    needed = asked.groupBy("article_id").agg(F.count_distinct("cell", "bit").alias("needed"))
    held = (hits.groupBy("article_id", "id_prefix", "ingest_batch").agg(F.count_distinct("cell", "bit").alias("held"))
            .filter("held >= 1"))  # true of all; a join prunes folders at run time only behind a filter of its own
    return held.join(needed, "article_id").filter(F.col("held") == F.col("needed")).select("article_id", "id_prefix", "ingest_batch")


def not_known(new: DataFrame, path: str, before_batch: int | None = None) -> DataFrame:
    """Rows of ``new`` (article_id, ...) whose id no batch has, or none before ``before_batch``."""
    spark = new.sparkSession
    maybe = may_be_known(new.select("article_id").distinct(), path, before_batch)
    folders = maybe.select("ingest_batch", "id_prefix").distinct()  # at most batches x prefixes
    ids = _read(spark, path, "ids", "article_id string, id_prefix int", before_batch)
    opened = ids.join(F.broadcast(folders), ["ingest_batch", "id_prefix"], "left_semi")
    seen = opened.join(maybe.select("article_id"), "article_id", "left_semi").select("article_id")
    return new.join(seen, "article_id", "left_anti")
