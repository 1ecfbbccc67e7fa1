"""Tables that a report writes for itself: where they go, and how they go away."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Shuffle files go when their execution ends, not when the driver happens to collect its garbage.
_DROP_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
# A task writes up to so many folders side by side; only for more it has to sort its rows by folder first.
_FOLDERS = {"spark.sql.maxConcurrentOutputFileWriters": "64"}


def staging_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, which a cluster has to name.

    Only a local master, where both are one process, may fall back to the folder of Spark's own tables.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/levelbook-staging"


def staged_path(spark: SparkSession, name: str) -> str:
    """A new path in that folder."""
    return f"{staging_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, path: str, by: str | None = None, more: bool = False) -> None:
    """Write ``df`` as Parquet to ``path``, a folder per value of ``by`` if there is one; ``more`` adds to what is there.

    The shuffle files behind ``df`` are deleted once it is written. They hold its rows at several times the size
    of these files, so steps that are staged one after the other need the disk of the largest one only.
    """
    spark = df.sparkSession
    settings = _DROP_SHUFFLES | (_FOLDERS if by else {})
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        writer = df.write.mode("append" if more else "error").option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def staged(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What :func:`stage` wrote, also if that is no row; ``schema`` has all columns, that of the folders last."""
    return spark.read.schema(schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
