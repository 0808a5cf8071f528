"""Numbers, checksum trees and the inverted index against plain computations."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import checksums, numbering, postings, search


def test_numbers_and_pages(spark, tmp_path):
    rows = spark.range(5003).select(F.col("id"), (F.col("id") * 7919 % 13).alias("k")).repartition(7)
    order = [F.desc("k"), F.col("id")]
    it = numbering.number(rows, order, f"{tmp_path}/n", ranges=9)
    want = [r["id"] for r in rows.orderBy(*order).collect()]
    assert it.total == 5003 and len(it.before) > 5
    assert [r["id"] for r in it.rows().orderBy("number").collect()] == want
    for page in (0, 1, 17, 42, 43):
        got = it.page(page).orderBy("position").collect()
        p = min(max(1, page), 42)
        assert [r["id"] for r in got] == want[(p - 1) * 120 : p * 120] and {r["pages"] for r in got} == {42} and got[0]["position"] == (p - 1) * 120 + 1
    assert {r["number"]: r["id"] for r in it.pick([1, 5003, 2000, 9999, 0]).collect()} == {1: want[0], 2000: want[1999], 5003: want[-1]}
    plan = it.page(30)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "_place" in plan.split("PushedFilters")[1]
    none = numbering.number(rows.where("false"), order, f"{tmp_path}/none")
    assert none.total == 0 and none.page(3).collect() == [] and none.rows().collect() == []


def test_files_in_order(spark, tmp_path):
    rows = spark.range(2000).select((F.col("id") * 7 % 2000).alias("id")).repartition(5)
    numbering.in_order(rows, [F.col("id")], 6).select(F.col("id").cast("string").alias("value")).write.text(f"{tmp_path}/t")
    parts = sorted(p for p in (tmp_path / "t").iterdir() if p.name.startswith("part-"))
    assert len(parts) == 6 and [int(x) for p in parts for x in p.read_text().split()] == list(range(2000))


def changed_by_hand(a, b):
    bag = lambda rows: {k: sorted(map(repr, (r for r in rows if r[0] == k))) for k in {r[0] for r in rows}}
    x, y = bag(a), bag(b)
    return {k: "added" if k not in x else "removed" if k not in y else "changed" for k in {*x, *y} if x.get(k) != y.get(k)}


@pytest.mark.parametrize("seed", range(3))
def test_changes_like_bags(spark, seed):
    rng = random.Random(seed)
    a = [(rng.choice([None, *range(60)]), rng.choice(["x", "y", None]), rng.choice([1.5, None])) for _ in range(150)]
    b = [r for r in a if rng.random() < 0.95] + [(rng.randint(0, 70), "new", None) for _ in range(5)] + a[:2]
    rng.shuffle(b)
    one, two = (spark.createDataFrame(x, "k long, s string, v double") for x in (a, b))
    want = changed_by_hand(a, b)
    assert {r["k"]: r["change"] for r in checksums.changes(one, two.select("v", "k", "s"), ["k"]).collect()} == want and want
    assert checksums.changes(one, one.repartition(5), ["k"]).collect() == []
    assert {r["change"] for r in checksums.changes(one, one.where("false"), ["k"]).collect()} == {"removed"}


def test_nulls_that_trade_places_differ(spark):
    a = spark.createDataFrame([(1, None, "x"), (2, "a", "b")], "k long, s string, t string")
    b = spark.createDataFrame([(1, "x", None), (2, "a", "b")], "k long, s string, t string")
    assert [(r["k"], r["change"]) for r in checksums.changes(a, b, ["k"]).collect()] == [(1, "changed")]
    with pytest.raises(ValueError):
        checksums.changes(a, b.drop("t"), ["k"])


def test_stored_trees_tell_what_to_read(spark, tmp_path):
    a = spark.range(20_000).select("id", (F.col("id") * 3).alias("v"))
    b = a.withColumn("v", F.when(F.col("id") == 777, -1).otherwise(F.col("v")))
    trees = tuple(checksums.written(spark, checksums.tree(x, ["id"]), f"{tmp_path}/{n}") for n, x in enumerate((a, b)))
    assert checksums.differing(*trees).count() == 1
    assert [tuple(r) for r in checksums.changes(a, b, ["id"], trees).collect()] == [(777, "changed")]


WORDS = ["salt", "sea", "seared", "fish", "fish stock", "stock", "rice", "old", "a"]


def records(rng, n):
    say = lambda k: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, k)))
    return [(i, say(3), rng.choice([None, say(2)]), [(say(2), [say(3) for _ in range(rng.randint(0, 2))]) for _ in range(rng.randint(0, 3))], say(6), rng.randint(0, 5)) for i in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_index_equals_rank(spark, tmp_path, monkeypatch, seed):
    rng = random.Random(seed)
    rows = spark.createDataFrame(records(rng, 300), "id long, title string, original string, items array<struct<canonical:string,terms:array<string>>>, meta string, shelf int")
    titles, order = [F.col("title"), F.col("original")], [F.desc("shelf"), F.col("id")]
    index = postings.build(rows, "id", order, titles, F.col("items"), F.col("meta"), f"{tmp_path}/index", block=16)
    monkeypatch.setattr(postings, "FIRST_STEP", 2)
    place = {r["id"]: n for n, r in enumerate(rows.orderBy(*order).select("id").collect())}
    terms, variants = {"fish stock": {"stock"}, "sea": {"salt"}}, {"stock": {"stock", "rice"}, "salt": {"salt"}}
    for text in ("salt", "fish stock", "sea", "sea s", "old fish", "rice a salt", "absent", "salt absent", "fish sea"):
        parts = search.parse_query(text.split(), terms, variants)
        want = {r["id"]: (r["priority"], r["n_items"]) for r in search.rank(rows, parts, titles, F.col("items"), F.col("meta")).collect()}
        assert {r["id"]: (r["priority"], r["n_items"]) for r in index.all(parts).collect()} == want, text
        best = sorted(want, key=lambda i: (want[i][0], -want[i][1], place[i]))[:7]
        got = index.search(parts, 7).orderBy("place").collect()
        assert [r["id"] for r in got] == best and [r["place"] for r in got] == list(range(1, len(best) + 1)), text
    assert [r["id"] for r in index.search([], 5).orderBy("place").collect()] == sorted(place, key=place.get)[:5]


def test_search_reads_its_terms_and_stops_early(spark, tmp_path, monkeypatch):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 1000 == 5, "rare title").otherwise("common title").alias("title"), F.lit(None).cast("array<struct<canonical:string,terms:array<string>>>").alias("items"), F.concat(F.lit("word"), F.col("id")).alias("meta"))
    index = postings.build(rows, "id", [F.col("id")], [F.col("title")], F.col("items"), F.col("meta"), f"{tmp_path}/index", block=50)
    seen = []
    real = postings.Index._evaluated
    monkeypatch.setattr(postings, "FIRST_STEP", 3)
    monkeypatch.setattr(postings.Index, "_evaluated", lambda self, query, blocks: seen.append(blocks) or real(self, query, blocks))
    got = index.search(search.parse_query(["common", "title"], {}, {}), 10).orderBy("place").collect()
    assert [r["id"] for r in got] == [*range(5), *range(6, 11)] and seen == [[0, 1, 2]]
    query = postings._Query(search.parse_query(["common", "title"], {}, {}))
    plan = real(index, query, [0, 1])._jdf.queryExecution().executedPlan().toString()
    assert "In(term" in plan.split("PushedFilters")[1] and "In(block" in plan.split("PushedFilters")[1]
    assert [r["id"] for r in index.search(search.parse_query(["rare"], {}, {}), 10).orderBy("place").collect()] == [5, 1005, 2005, 3005]


def test_numbers_within_groups_and_bins(spark, tmp_path):
    rows = spark.range(2000).select("id", F.when(F.col("id") % 50 > 0, "hot").when(F.col("id") % 100 == 0, "few").alias("g")).repartition(6)
    out = numbering.within_groups(rows, ["g"], [F.desc("id")], f"{tmp_path}/w")
    want = {}
    for r in sorted(rows.collect(), key=lambda r: -r["id"]):
        want.setdefault(r["g"], []).append(r["id"])
    assert {(r["g"], r["id"], r["place"]) for r in out.collect()} == {(g, i, n + 1) for g, ids in want.items() for n, i in enumerate(ids)}
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    chunk = {(r["g"], r["id"]): r["chunk"] for r in numbering.chunks(rows, 200, ["g"], [F.desc("id")], f"{tmp_path}/c").collect()}
    assert chunk == {(g, i): n // 200 for g, ids in want.items() for n, i in enumerate(ids)}
    assert [r["bin"] for r in numbering.dealt(rows, 3, [F.col("id")], f"{tmp_path}/d").orderBy("id").limit(5).collect()] == [0, 1, 2, 0, 1]
    assert [r["bin"] for r in numbering.dealt(rows.where("id < 2"), 3, [F.col("id")], f"{tmp_path}/e").orderBy("id").collect()] == [0, 1]
