"""Sitemaps: one row for each <url>, with the product id and slug of its path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_sitemap(spark: SparkSession, path: str, product: str = r"/([a-z0-9-]+)/id_([0-9]+)$") -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", "url").schema("loc string").load(path)
    url = F.trim("loc")
    return rows.select(url.alias("source_url"), F.regexp_extract(url, product, 1).alias("slug"), F.regexp_extract(url, product, 2).alias("product_id")).where("product_id <> ''")
