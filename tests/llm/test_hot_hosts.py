from pyspark.sql import functions as F

from weftline.llm import decontaminate, url_filters


def test_a_hot_host_is_cut_into_pieces(spark, monkeypatch):
    """Half of the captures are of one parent domain on one day; the long list's way gives what the short one's gives."""
    caps = spark.range(3000).select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("http://h"), "id", F.lit(".hot.example/a/b"))).otherwise(F.concat(F.lit("http://x"), "id", F.lit(".example/"))).alias("url"), F.lit("2024-02-02").cast("date").alias("fetched"))
    changes = spark.createDataFrame([("hot.example", "a", "add"), ("hot.example", "b", "add"), ("x5.example", "c", "add")], "key string, category string, action string").withColumn("day", F.lit("2024-01-01").cast("date"))
    got = []
    for bound in (100, 0):
        monkeypatch.setattr(url_filters, "BROADCAST_ROWS", bound)
        got.append(sorted((r["id"], r["matched_keys"], r["categories"]) for r in url_filters.filter_urls(caps, changes, id_col="id").collect()))
    assert got[0] == got[1] and sum(r[2] == ["a", "b"] for r in got[0]) == 1500


def test_a_long_item_comes_in_pieces(monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 7)
    for n in (0, 1, 3, 7, 8, 30):
        words = [f"W{k}é" for k in range(n)]
        pieces = list(decontaminate._pieces("- ".join(words), 4))
        assert all(size <= 7 for _, size in pieces)
        windows = {tuple(w[p : p + 4]) for w in (piece.split("- ") for piece, _ in pieces) for p in range(len(w) - 3)}
        assert windows == {tuple(words[p : p + 4]) for p in range(n - 3)}
