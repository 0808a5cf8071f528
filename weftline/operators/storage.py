"""Folders that the driver and all executors share, for tables that an operator keeps between its steps."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared(spark: SparkSession, what: str) -> str:
    """A new folder's path below the one that the cluster names in spark.checkpoint.dir, else below the warehouse.

    A warehouse on one machine's disk serves a local master only; on a cluster it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    root = named or spark.conf.get("spark.sql.warehouse.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() == "file":
            raise ValueError("set spark.checkpoint.dir: the warehouse is a folder of the driver's machine")
    return f"{root}/weftline/{what}-{uuid.uuid4().hex}"


def hadoop(spark: SparkSession, path: str):
    """(path, file system) of a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = hadoop(spark, path)
    return fs.exists(at)


def fresh(name: str, columns: list[str]) -> str:
    """name, with as many leading underscores as keep it apart from columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name
