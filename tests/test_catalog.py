"""Signals, scope, the site and the audits on inline fixtures, nulls and empty tables included."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weftline.operators import scope, signals, site, validation

RECORDS = (
    "id string, title string, score double, source_url string, facts string, cuisines array<string>, meal_types array<string>, proteins array<string>, methods array<string>, times array<string>, "
    "items array<string>, steps array<string>, attribution string, license string"
)


def record(i, title, score, url=None, steps=("Mix.",), items=("30 mL oil",)):
    return (i, title, score, url, "20 min", ["Italian"], ["Pasta"], ["Other"], ["Oven"], ["Unknown"], list(items) if items else None, list(steps) if steps else None, None, None)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_signals(spark):
    none = F.lit(None).cast("array<string>")
    s = signals.with_practical(spark.range(1), none, "p").first()["p"]
    assert (s["operations"], s["vessels"], s["lower_bound"], s["advance"], s["labour"]) == (0, [], 0.0, False, False)
    s = signals.with_practical(spark.range(1), F.array(F.lit("Knead in a bowl, deep-fry. Rest two hours. Store for 9 hours.")), "p").first()["p"]
    assert (s["operations"], s["vessels"], s["lower_bound"], s["labour"]) == (2, ["bowl"], 120.0, True)
    assert value(spark, signals.method_tags(F.lit("One-pot soup"), F.array(F.lit("Oven")), none, none)) == ["oven", "one-pan"]
    assert value(spark, signals.practical_methods(none, F.lit("One_pan salad"), F.lit("Salad"), F.array(F.lit("Toss.")))) == ["no-cook", "one-pan"]
    assert value(spark, signals.method_labels(F.array(F.lit("oven"), F.lit("x")), F.lit("Grilled fish"), none)) == ["Grill", "Oven"]
    assert value(spark, signals.method_labels(none, F.lit(None).cast("string"), none)) == ["Other"]
    names, known = F.array(F.lit("tofu"), F.lit("rice")), F.array(F.lit("tofu"), F.lit("rice"), F.lit("beef"))
    assert value(spark, signals.protein_labels(F.lit("tofu"), names, known, F.array(F.lit("beef")))) == ["Tofu", "Vegetarian"]
    assert value(spark, signals.protein_labels(F.lit(None).cast("string"), F.array(F.lit("beef")), known, F.array(F.lit("beef")))) == ["Other"]
    assert value(spark, signals.facts(F.lit(7.5), F.array(F.lit("Oven"), F.lit("Other")))) == "7.5 min · Oven"
    assert value(spark, signals.facts(F.lit(200.0), none)) == "200 min"
    assert value(spark, signals.facts(F.lit(None).cast("double"), none)) == ""
    issues = value(spark, signals.dish_issues(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a")), F.array().cast("array<struct<original_text:string,quantity:double>>"), none, 3))
    assert issues["unresolved"] == 0.5 and issues["issues"] == ["no parsed instructions", "too few meaningful parsed ingredients"]


def test_scope(spark):
    paths = {"a/b.md": True, "a/.x/b.md": False, "docs/b.md": False, "README.md": False, "lang/r.gz": True, "recipe_list.csv": True, "x.csv": False, "x/testdata/a.json": True, "x/testdata/report.json": False, "a.py": False, "noext": False}
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", scope.may_hold_records(F.col("p")).alias("x")).collect()
    assert {r["p"]: r["x"] for r in rows} == paths
    n = F.lit(None).cast("string")
    assert value(spark, scope.source_status(F.lit("disabled"), F.lit(1), F.lit(0), F.lit(0), n)) == "NOT_A_RECIPE_SOURCE"
    assert value(spark, scope.source_status(n, F.lit(0), F.lit(0), F.lit(0), n)) == "COMPLETE"
    assert value(spark, scope.public_product_id(F.lit("https://a.shop.example.com/x/id_7?q"), "shop.example.com", "/id_([0-9]+)$")) == "7"
    assert value(spark, scope.public_product_id(F.lit("https://notshop.example.com/x/id_7"), "shop.example.com", "/id_([0-9]+)$")) is None
    assert value(spark, scope.group_basis(F.lit("Thai food"), ["thai"], n, {}))["kind"] == "explicit"
    assert value(spark, scope.group_basis(n, ["thai"], F.lit("x/cook"), {"x/cook": "why"}))["value"] == "why"
    assert value(spark, scope.group_basis(n, ["thai"], n, {"x": "why"})) is None


def test_site(spark, tmp_path):
    rows = spark.createDataFrame([record("b", "Beta & co", 50.0, "https://x.example/1"), record("a", "alpha", None, steps=None, items=None), record("c/d", "Beta & co", 50.0), record("z", None, 90.0)], RECORDS)
    folder = str(tmp_path / "site")
    assert site.write_site(rows, folder) == 5
    index = Path(folder, "index.html").read_text()
    assert re.findall('data-recipe-id="([^"]*)"', index) == ["z", "b", "c/d", "a"]
    pages = sorted(p.name for p in Path(folder, "recipes").glob("*.html"))
    assert len(pages) == 4 and "b.html" in pages
    assert "<h1>Beta &amp; co</h1>" in Path(folder, "recipes/b.html").read_text()
    before = index
    assert site.write_site(rows.repartition(3), folder) == 5 and Path(folder, "index.html").read_text() == before
    with pytest.raises(ValueError):
        site.write_site(spark.createDataFrame([record("b", "x", 1.0, steps=("Add 1 tbsp oil",))], RECORDS), folder)
    assert site.write_site(spark.createDataFrame([], RECORDS), str(tmp_path / "none")) == 1
    assert {(r["axis"], r["label"]): r["id"] for r in site.membership(rows.where("id = 'b'")).collect()}[("methods", "Oven")] == "b"


def test_audits(spark):
    rows = spark.createDataFrame([record("b", "x", 1.0), record("c", "y", 1.0)], RECORDS)
    entries, pages = site.index_entries(rows), site.detail_pages(rows)
    wanted = rows.select("id", F.col("id").alias("representative"), "steps")
    assert validation.catalog_faults(entries, pages, wanted).count() == 0
    more = wanted.unionByName(spark.createDataFrame([("d", "d", ["z"]), ("e", "d", ["z"])], "id string, representative string, steps array<string>"))
    assert [tuple(r) for r in validation.catalog_faults(entries, pages, more).collect()] == [("record missing from the index", "d")]
    frame = spark.createDataFrame
    raw = frame([("1", "k1", "s", "p"), ("2", "k2", None, "p")], "id string, key string, source string, path string")
    normal = frame([("1", "1"), ("3", "9")], "id string, raw_id string")
    found = validation.pipeline_faults(raw, normal, frame([("1",), ("1",), ("8",)], "id string"), frame([("k1",)], "key string"), frame([("k1",)], "key string"), frame([("k1",), ("k3",)], "key string"))
    assert {tuple(r) for r in found.collect()} == {
        ("normalized without raw", "9"), ("raw without provenance", "2"), ("match without record", "8"), ("record without match", "3"), ("several matches", "1"), ("unaccounted file", "k3"), ("processed and failed", "k1"),
    }
    texts = frame([(1, ["2 tbsp oil"]), (2, ["30 mL"]), (3, None)], "k int, t array<string>")
    assert [r["key"] for r in validation.forbidden_units(texts, "k", ["t"]).collect()] == ["1"]
    assert validation.rerun_faults(texts.select("k"), texts.select("k"), "k").count() == 0
