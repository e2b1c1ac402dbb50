"""Stored tables.

A table that is rewritten (feeds, or articles after a delete) is a folder of
version folders plus an append-only ``current_version`` table of version names; readers
take the newest name.  A reader that is under way keeps its version, a writer
that dies leaves a folder nobody points to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import scratch_path


# of a file that lists the same articles many times: their ids as numbers, not as text each time
ID_PAGES = {"parquet.dictionary.page.size": str(16 << 20)}


def pieces(spark: SparkSession, folders: int) -> int:
    """Into how many pieces each of ``folders`` is cut, so that there are two for every shuffle task."""
    return max(1, -(-2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // folders))


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files of the tables that ``df`` is made of, with those that a filter leaves out; 0 where there are none."""
    spark = df.sparkSession
    conf, path = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = [path(name) for name in df.inputFiles()]
    return sum(f.getFileSystem(conf).getFileStatus(f).getLen() for f in files)


def tasks_for(spark: SparkSession, size: int, most: int, least: int) -> int:
    """Tasks of about ``most`` bytes for ``size`` bytes; of fewer, down to ``least``, while there are idle cores."""
    return max(-(-size // most), min(spark.sparkContext.defaultParallelism, -(-size // least)), 1)


def scan(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Scan with a given schema: nothing is inferred, unused columns are not read."""
    return spark.read.schema(schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at ``path``; other problems with it are not taken for absence."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def kept(rows: DataFrame, label: str) -> DataFrame:
    """A small table, written to the shared folder: what is joined with it later knows how small it is.

    Feeds and their keys may be the result of a job whose size nobody knows, and then every article would be
    shuffled to meet a few of them.
    """
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, label)
    rows.coalesce(1).write.parquet(path)
    return scan(spark, path, rows.schema)


def publish(df: DataFrame, path: str, version: str) -> None:
    """Write ``version`` of the table at ``path`` and make it current."""
    df.write.mode("overwrite").parquet(f"{path}/{version}")
    point_at(df.sparkSession, path, version)


def point_at(spark: SparkSession, path: str, version: str) -> None:
    (spark.createDataFrame([(version,)], "version string")
     .withColumn("published_at", F.current_timestamp())
     .coalesce(1).write.mode("append").parquet(f"{path}/current_version"))


def current_version(spark: SparkSession, path: str) -> str | None:
    pointer = f"{path}/current_version"
    if not exists(spark, pointer):
        return None
    row = (spark.read.schema("version string, published_at timestamp").parquet(pointer)
           .agg(F.max_by("version", F.struct("published_at", "version")).alias("v")).first())
    return row.v


def read_current(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    version = current_version(spark, path)
    if version is None:
        return spark.createDataFrame([], schema)
    return scan(spark, f"{path}/{version}", schema)


def write_batch(df: DataFrame, path: str, batch_id: int, partitions: tuple[str, ...] = (),
                looked_up_by: str | None = None, options: dict[str, str] | None = None) -> None:
    """Write the rows of one batch; a replay replaces exactly these rows, also by none.

    The batch is a folder of its own that is overwritten as a whole, so a repeat that has fewer rows
    or partitions leaves none of the old ones.  ``looked_up_by`` gets a bloom filter per row group,
    for later look-ups by value; ``options`` are those of the writer.
    """
    writer = (df.write.mode("overwrite").option("partitionOverwriteMode", "static").option("compression", "zstd")
              .options(**(options or {})))
    if looked_up_by:
        writer = (writer.option(f"parquet.bloom.filter.enabled#{looked_up_by}", "true")
                  .option(f"parquet.bloom.filter.expected.ndv#{looked_up_by}", "1000000"))
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.parquet(f"{path}/ingest_batch={batch_id}")


def read_batches(spark: SparkSession, path: str, schema: StructType,
                 before_batch: int | None = None) -> DataFrame:
    """All batches, or those before ``before_batch`` (partition pruning)."""
    full = StructType(list(schema.fields)).add("ingest_batch", "long")
    if not exists(spark, path):
        return spark.createDataFrame([], full)
    df = scan(spark, path, full)
    return df if before_batch is None else df.filter(F.col("ingest_batch") < before_batch)
