"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Options the jobs rely on.  They are defaults of recent Spark versions or
# harmless on any cluster; sizes that depend on the cluster are left alone.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def local_session(cpus: int | str = "*", memory: str = "8g", partitions: int = 8,
                  app: str = "newsloom") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    spark = (builder
             .config("spark.ui.enabled", "false")
             .config("spark.driver.memory", memory)
             .config("spark.sql.shuffle.partitions", str(partitions))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset,
    and only in local mode, a temporary folder is made and remembered in the
    session so that later calls agree on it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    root = spark.conf.get("spark.newsloom.scratch", None)
    if not root:
        root = tempfile.mkdtemp(prefix="newsloom-")
        spark.conf.set("spark.newsloom.scratch", root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under :func:`shared_root`; never reused between runs."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
