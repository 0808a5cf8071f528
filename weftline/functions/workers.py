"""Python workers: lets them import this package where the driver found it by sys.path alone."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def ready(spark: SparkSession) -> SparkSession:
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(":")
    if ROOT not in known:
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, *known) if x)
    return spark
