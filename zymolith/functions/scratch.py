"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Paths and tables that this process has written to.
_PATHS: list[str] = []
_TABLES: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset, in a local session as in tests, a folder is made
    and set for the session; a cluster without the setting is refused, because its
    executors would each write to a disk of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="zymolith-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    _PATHS.append(f"{scratch_dir(spark)}/zymolith-{name}-{os.getpid()}-{uuid.uuid4().hex}")
    return _PATHS[-1]


def clear_scratch(spark: SparkSession) -> int:
    """Deletes what this process has written to the shared folder; results that still read it must be written first."""
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), len(_PATHS)
    while _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop()}")
    while _PATHS:
        path = jvm.org.apache.hadoop.fs.Path(_PATHS.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns a scan of it.

    This cuts the lineage: a lost executor costs a re-read of files that every
    executor sees, not a recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder as a table in buckets of ``key``; joins by the key move the other side only.

    There are as many buckets as shuffle partitions, below which Spark would move both sides again.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, table = scratch_path(spark, name), f"zymolith_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(table)
    _TABLES.append(table)
    return spark.table(table)
