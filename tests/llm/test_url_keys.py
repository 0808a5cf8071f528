import pytest
from pyspark.sql import functions as F

from weftline.llm import url_filters


def test_one_label_and_upper_case_keys(spark):
    changes = [("zip", "tld", "add"), ("Bad.Example", "spam", "add"), ("bad.example", "spam", "remove"), ("A.Example/X", "path", "add")]
    listed = spark.createDataFrame(changes, "key string, category string, action string").withColumn("day", F.when(F.col("action") == "add", "2024-01-01").otherwise("2024-02-01").cast("date"))
    urls = [("http://a.b.zip/", "2024-01-05"), ("http://zip/", "2024-01-05"), ("http://w.bad.example/", "2024-01-05"), ("http://bad.example/", "2024-02-05"), ("http://a.example/X/y", "2024-01-05"), ("http://a.example/x", "2024-01-05"), ("http://zip.example/", "2024-01-05")]
    caps = spark.createDataFrame([(i, u, d) for i, (u, d) in enumerate(urls)], "page_id long, url string, fetched string").withColumn("fetched", F.col("fetched").cast("date"))
    rows = url_filters.filter_urls(caps, listed).orderBy("page_id").collect()
    assert [r["matched_keys"] for r in rows] == [["zip"], ["zip"], ["bad.example"], [], ["a.example/X"], [], []]


def test_keys_with_a_final_dot(spark):
    listed = spark.createDataFrame([("bad.example.", "spam"), ("Worse.Example./x", "spam"), ("dot.", "tld")], "key string, category string").selectExpr("*", "date'2024-01-01' AS day", "'add' AS action")
    urls = ["http://bad.example/", "http://w.bad.example./", "http://worse.example/x/y", "http://worse.example/y", "http://a.dot./"]
    caps = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("fetched", F.lit("2024-02-01").cast("date"))
    rows = url_filters.filter_urls(caps, listed).orderBy("page_id").collect()
    assert [r["matched_keys"] for r in rows] == [["bad.example"], ["bad.example"], ["worse.example/x"], [], ["dot"]]


@pytest.mark.parametrize("url", ["http://hot.example/", "http://other.example/", None])
def test_one_url_with_many_captures_is_dealt(spark, url):
    """Matched, unmatched or null: no task of the last join holds more than a small part of a hot URL's captures."""
    listed = spark.createDataFrame([("hot.example", "spam")], "key string, category string").selectExpr("*", "date'2024-01-01' AS day", "'add' AS action")
    caps = spark.range(6000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 > 0, F.lit(url)).otherwise(F.concat(F.lit("http://h"), "id", F.lit(".example/"))).alias("url"), F.lit("2024-02-01").cast("date").alias("fetched"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(before, ("64", "false", "-1"), strict=True):
            spark.conf.set(k, v)
        out = url_filters.filter_urls(caps, listed)
        assert out.where("blocked").count() == (4000 if url == "http://hot.example/" else 0)
        assert out.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0] < 400
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
