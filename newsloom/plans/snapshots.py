"""Snapshots of stored tables: take, check, restore."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..sources import tables


def fingerprint(df: DataFrame) -> DataFrame:
    """``(row_count, content_hash)``: independent of row order, one narrow pass.

    Equal rows would cancel in an exclusive-or, so the sum of hashes is taken instead;
    it is a decimal, which does not overflow.
    """
    columns = [F.to_json(c) if kind.startswith("map") else F.col(c) for c, kind in df.dtypes]
    total = F.sum(F.xxhash64(*columns).cast("decimal(20,0)"))
    return df.agg(F.count("*").alias("row_count"),
                  F.coalesce(F.pmod(total, F.lit(2 ** 61 - 1)).cast("long"), F.lit(0)).alias("content_hash"))


def stored_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Size of the files of a written table, from their listing; no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def take(tables_by_name: dict[str, DataFrame], root: str, snapshot_ts: str,
         compress: bool = True) -> DataFrame:
    """Copy tables under ``root/snapshot_ts`` and add a row per table to the catalogue.

    The figures are taken from the written copy.
    """
    spark = next(iter(tables_by_name.values())).sparkSession
    codec = "zstd" if compress else "uncompressed"
    for name, df in tables_by_name.items():
        df.write.mode("overwrite").option("compression", codec).parquet(f"{root}/{snapshot_ts}/{name}")
    rows = None
    for name in tables_by_name:
        path = f"{root}/{snapshot_ts}/{name}"
        row = fingerprint(spark.read.parquet(path)).select(
            F.lit(snapshot_ts).alias("snapshot_ts"), F.lit(name).alias("table_name"),
            F.lit(path).alias("path"), "row_count", "content_hash", F.lit(codec).alias("compression"),
            stored_bytes(spark, path).scalar().alias("bytes"))
        rows = row if rows is None else rows.unionByName(row)
    rows.coalesce(1).write.mode("append").parquet(f"{root}/catalogue")
    return catalogue(spark, root).filter(F.col("snapshot_ts") == snapshot_ts)


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    return tables.scan(spark, f"{root}/catalogue", schemas.SNAPSHOTS)


def restore(spark: SparkSession, root: str, snapshot_ts: str, targets: dict[str, str],
            safety_ts: str) -> bool:
    """Put a snapshot back; ``targets`` maps table names to versioned table folders.

    The current state is saved first.  Every table is written as a new version and
    compared with the catalogue; only when all agree do the pointers move, and if one cannot be
    moved, those that were go back.  So a failed restore leaves the current tables in place.  Tables of
    one home, whose pointers are one row, are put back by :func:`restore_home`.
    """
    wanted = {r.table_name: r for r in catalogue(spark, root)
              .filter(F.col("snapshot_ts") == snapshot_ts)
              .filter(F.col("table_name").isin(list(targets))).collect()}
    if set(wanted) != set(targets):
        return False
    before = {name: tables.current_version(spark, path) for name, path in targets.items()}
    current = {name: spark.read.parquet(f"{targets[name]}/{version}") for name, version in before.items() if version is not None}
    if current:
        take(current, root, safety_ts)
    version = f"restored-{snapshot_ts}-{safety_ts}"
    if not all(_put_back(spark, wanted[name], f"{path}/{version}") for name, path in targets.items()):
        return False
    moved = []
    try:
        for name, path in targets.items():
            moved.append(name)
            tables.point_at(spark, path, version)
    except Exception:
        for name in moved:
            if before[name] is not None:
                tables.point_at(spark, targets[name], before[name])
        return False
    return True


def _put_back(spark: SparkSession, wanted, path: str) -> bool:
    """Copy one table of a snapshot to ``path``; whether the copy is what the catalogue says."""
    try:
        spark.read.parquet(wanted.path).write.mode("overwrite").parquet(path)
        found = fingerprint(spark.read.parquet(path)).first()
    except Exception:
        return False
    return (found.row_count, found.content_hash) == (wanted.row_count, wanted.content_hash)


def publish_home(tables_by_name: dict[str, DataFrame], home: str, version: str) -> None:
    """Write ``version`` of several tables and make all of them current by one row of one table."""
    for name, df in tables_by_name.items():
        df.write.mode("overwrite").parquet(f"{home}/{version}/{name}")
    tables.point_at(next(iter(tables_by_name.values())).sparkSession, home, version)


def read_home(spark: SparkSession, home: str, name: str) -> DataFrame:
    """The current version of one table of a home."""
    return spark.read.parquet(f"{home}/{tables.current_version(spark, home)}/{name}")


def restore_home(spark: SparkSession, root: str, snapshot_ts: str, home: str, names: list[str], safety_ts: str) -> bool:
    """Put the tables ``names`` of a snapshot back as one new version of ``home``.

    Readers see all of them change at once, or, where any copy is not what the catalogue says, none.
    """
    wanted = {r.table_name: r for r in catalogue(spark, root).filter(F.col("snapshot_ts") == snapshot_ts)
              .filter(F.col("table_name").isin(names)).collect()}
    if set(wanted) != set(names):
        return False
    if tables.current_version(spark, home) is not None:
        take({name: read_home(spark, home, name) for name in names}, root, safety_ts)
    version = f"restored-{snapshot_ts}-{safety_ts}"
    if not all(_put_back(spark, wanted[name], f"{home}/{version}/{name}") for name in names):
        return False
    tables.point_at(spark, home, version)
    return True
