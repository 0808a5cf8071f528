import random
import time

from weftline.llm import jaccard_join
from weftline.llm.common import spread_join


def test_null_ids_cost_no_more(spark):
    """3,000 rows in pairs of near copies take about as long with null ids as with ids of their own."""
    rng, rows, took = random.Random(1), [], {}
    for k in range(1500):
        words = [f"w{rng.randrange(9000)}" for _ in range(40)]
        rows += [" ".join(words), " ".join([*words, "end"])]
    for ids in (True, False, True, False):
        docs = spark.createDataFrame([(k if ids else None, t) for k, t in enumerate(rows)], "doc_id long, text string")
        began = time.perf_counter()
        got = jaccard_join.jaccard_join(docs).collect()
        took[ids] = time.perf_counter() - began
        assert len(got) == 3000 and {r["n_links"] for r in got} == {1}
    assert took[False] < 2 * took[True] + 2


def test_chained_texts_are_not_compared_all_with_all(spark, monkeypatch):
    """A chain in which only neighbours are similar: its units hold far fewer pairs than the chain has."""
    n, length, step = 300, 120, 8
    stream = [f"t{k}" for k in range(n * step + length)]
    docs = spark.createDataFrame([(k, " ".join(stream[k * step : k * step + length])) for k in range(n)], "doc_id long, text string")
    compared = []
    real = jaccard_join._prune

    def counted(units, threshold):
        sizes = units.groupBy("band", "bucket", "lo", "hi").count().collect()
        compared.append(sum(r["count"] ** 2 for r in sizes))
        return real(units, threshold)

    monkeypatch.setattr(jaccard_join, "_prune", counted)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_join(docs).collect()}
    assert got == {k: (0, (k > 0) + (k < n - 1)) for k in range(n)}
    assert compared[0] < n * n / 3


def test_spread_join_keeps_every_row(spark):
    big = spark.range(5000).selectExpr("case when id % 3 = 0 then 1 when id % 50 = 1 then null else id end as k", "id as v")
    small = big.where("k is not null and k <> 7").groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "k * 2 as twice", "n")
    rows = {r["v"]: r["twice"] for r in spread_join(big, small, ["k"], "n", 5000, "left").collect()}
    assert len(rows) == 5000 and rows == {r["v"]: None if r["k"] in (None, 7) else 2 * r["k"] for r in big.collect()}
    assert spread_join(big, small, ["k"], "n", 5000).count() == sum(x is not None for x in rows.values())
