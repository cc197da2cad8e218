"""Where tables and files that a plan writes for itself go: a folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster names in ``spark.checkpoint.dir``, or in the warehouse where that is unset. It goes when the driver's JVM ends."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    root = (named or spark.conf.get("spark.sql.warehouse.dir") + "/scratch").rstrip("/")
    path = f"{root}/lumenspan/{name}-{uuid.uuid4().hex}"
    system, where = _located(spark, path)
    system.deleteOnExit(where)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read back: what several passes need is worked out in one."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put(spark: SparkSession, path: str, content: bytes) -> str:
    """Writes one small file, through the file system that the path names."""
    system, where = _located(spark, path)
    out = system.create(where, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    return path


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _located(spark, path)
    return system.exists(where)


def _located(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where
