"""Readers of captured files, archives, git trees, and collection runs over them."""

import gzip
import io
import json
import subprocess
import zipfile

import pytest
from pyspark.sql import functions as F

from weftline.operators import collection
from weftline.sources import archive, documents, gittree, prose


def one(text, path):
    (r,) = documents.parse(text, path)
    return r["title"], r["ingredients"], r["instructions"]


CASES = [
    ("# Beans\n## Ingredients\n- 1 can beans\n## Instructions\n1. Heat.\n2. Serve.\n## Notes\n- none", "beans.md", ("Beans", ["1 can beans"], ["Heat.", "Serve."])),
    ("## You will need\n| 1 cup | rice |\n|---|---|\n## Method\nBoil.", "plain-rice.md", ("plain rice", ["1 cup | rice"], ["Boil."])),
    ("# 蛋\n## 必备原料和工具\n- 鸡蛋\n## 计算\n- 鸡蛋 2 个\n## 操作\n- 煎", "x.md", ("蛋", ["鸡蛋 2 个"], ["煎"])),
    ("---\ntitle: Dal\ningredients: [lentils]\ndirections: [Boil.]\n---\nx", "x.md", ("Dal", ["lentils"], ["Boil."])),
    ("# Salsa\n* Tomato\n* Onion\n\nChop and combine.\n", "salsa.md", ("Salsa", ["Tomato", "Onion"], ["Chop and combine."])),
    ("Stew\n====\n\nServes 4\n1 lb beef\n3 carrots\n2 onions,\nvery large\n\nFry the beef.\nCook.\n\nComments\nNice", "s.md", None),
    ('<script type="application/ld+json">{"@graph":[{"@type":"Recipe","name":"Rice &amp; Peas","recipeIngredient":["rice"],"recipeInstructions":[{"@type":"HowToStep","text":"<b>Cook.</b>"}]}]}</script>', "r.html", ("Rice &amp; Peas", ["rice"], ["Cook."])),
    ('<html><title>Site</title><div itemscope itemtype="http://schema.org/Recipe"><h1 itemprop="name">Soup</h1><meta itemprop="recipeIngredient" content="water"><p itemprop="recipeInstructions">Boil <b>it</b>.</p><div itemscope itemtype="http://schema.org/Person"><i itemprop="name">Ann</i></div></div>', "s.html", ("Soup", ["water"], ["Boil it ."])),
    ('<title>Pie</title><ul><li class="x wprm-recipe-ingredient">1 <b>egg</b></li></ul><div class="recipe-instruction">Bake.</div>', "p.html", ("Pie", ["1 egg"], ["Bake."])),
    ('<div class="recipe"><h2 itemprop="name">Toast</h2><div><p class="recipeIngredient">bread</p></div><div class="instruction">Toast it.</div></div>', "t.html", ("Toast", ["bread"], ["Toast it."])),
    ("Title,In gredients,Directions,Total Time\nTea,water,Boil.,5\nx,,y,\n", "t.csv", ("Tea", ["water"], ["Boil."])),
    (json.dumps({"a": [{"title": "T", "what": {"flour": "1 g", "top": {"salt": "2 g"}}, "how": "Mix.\nBake."}]}), "a.json", ("T", ["1 g flour", "2 g salt"], ["Mix.", "Bake."])),
    (json.dumps({"name": "T", "steps": [{"instruction": "Mix.", "ingredients": [{"amount": 2, "unit": {"name": "g"}, "food": {"name": "salt"}}, {"is_header": True}]}]}), "a.json", ("T", ["2 g salt"], ["Mix."])),
    (json.dumps({"analyzeResult": {"content": "Cake\nIngredients\n1 egg\n2 g salt\nMethod\nMix."}}), "a.json", ("Cake", ["1 egg", "2 g salt"], ["Mix."])),
]


@pytest.mark.parametrize("text,path,want", [c for c in CASES if c[2]])
def test_readers(text, path, want):
    if path.endswith(".md") and text.startswith("---") and prose.yaml is None:
        pytest.skip("no YAML here")
    assert one(text, path) == want


def test_layouts():
    r = prose.recovered(CASES[5][0], "s.md")[0]
    assert r["title"] == "Stew" and r["ingredients"] == ["1 lb beef", "3 carrots", "2 onions, very large"] and r["instructions"] == ["Fry the beef.", "Cook."]
    assert prose.leading_list("A\n===\n- x\n- y\n\nMix.\n1. Bake.\n# Notes\nz", "a.md")[0]["instructions"] == ["Mix.", "Bake."]
    assert prose.interleaved("# A\nChop:\n- x\nFry:\n- y", "a.md")[0]["ingredients"] == ["x", "y"]
    two = "# A\n## Ingredients\n- x\n## Method\ny\n# B\n## Ingredients\n- z\n## Method\nw"
    assert [r["title"] for r in documents.parse(two, "a.md")] == ["A", "B"]
    assert documents.parse("https://example.com/\n- Home\n- Contact\n", "a.gz") == []
    assert documents.parse('{"name":"app","dependencies":{}}', "package.json") == []
    assert documents.parse("", "a.md")[0]["ingredients"] == []
    assert documents.parse("<p", "a.html") == [] and documents.parse("{", "a.json") == []
    mixed = "x\nIngredients\n1 a\nMethod\nMix.\nIngredients\n1 b\nMethod\nMix."
    assert prose.recovered(mixed, "a.gz", archive=True) == [] and prose.recovered(mixed, "a.md")
    with pytest.raises(archive.NoRecords):
        documents.parse("title,ingredients,directions\nTest Recipe 1,test one,Directions. Will go here.\n", "a.csv")


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


GOOD = "# A\n## Ingredients\n- x\n## Method\ny"


def test_archives():
    inner = zipped({"b.md": GOOD})
    paprika = gzip.compress(json.dumps({"name": "P", "ingredients": "a\nb", "directions": "c"}).encode())
    records, outcomes = archive.members(zipped({"a.md": GOOD, "in.zip": inner, "p.paprikarecipe": paprika, "x.png": b"1", "../e.md": GOOD, "bad.json": "{", "d/y.sqlite": b""}), documents.parse)
    said = {o["member"]: o["status"] for o in outcomes}
    assert said == {"a.md": "processed", "in.zip": "processed", "in.zip!b.md": "processed", "p.paprikarecipe": "processed", "x.png": "excluded", "../e.md": "failed", "bad.json": "failed", "d/y.sqlite": "unsupported"}
    assert sorted(r["member"] for r in records) == ["a.md", "in.zip!b.md", "p.paprikarecipe"]
    with pytest.raises(ValueError):
        archive.members(zipped({"1.zip": zipped({"2.zip": b""})}), documents.parse, depth=2)


def test_relational_archive():
    table = lambda *rows: archive.ROW_MARK.join(archive.FIELD_MARK.join(r) for r in rows)
    files = {
        "temp_recipe.dsv": table(("ID", "INSTRUCTIONS", "SERVES"), ("1", "Mix.", "2"), ("2", "Bake.", "")), "temp_recipe_desc.dsv": table(("ID", "TITLE"), ("1", "Dough"), ("2", "Odd")),
        "temp_ingredient.dsv": table(("PARENT_ID", "DISPLAY_ORDER", "INGREDIENT_FOOD_ID", "INGREDIENT_RECIPE_ID", "AMOUNT_UNIT", "AMOUNT_QTY_STRING"), ("1", "10", "f2", "", "", "1"), ("1", "2", "f1", "", "u", "3"), ("2", "1", "gone", "", "", "1")),
        "temp_food.dsv": table(("ID", "NAME"), ("f1", "flour"), ("f2", "egg")), "temp_unit.dsv": table(("ID", "NAME"), ("u", "cups")),
    }
    records, outcomes = archive.members(zipped(files), documents.parse)
    assert [(r["title"], r["ingredients"]) for r in records] == [("Dough", ["3 cups flour", "1 egg"])]
    assert {o["member"]: o["status"] for o in outcomes}["temp_recipe.dsv#2"] == "failed"


def test_collect(spark, tmp_path):
    folder = str(tmp_path / "state")
    files = lambda *rows: spark.createDataFrame([(s, p, bytearray(c) if c is not None else None) for s, p, c in rows], "source string, path string, content binary")
    first = files(("s", "a.md", GOOD.encode()), ("s", "a.md", GOOD.encode()), ("s", "b.md", b"nothing"), ("t", "z.zip", zipped({"c.md": GOOD})), ("t", "n.md", None))
    collection.collect(spark, first, folder, "run-1")
    state = lambda name: collection.state(spark, folder, name)
    assert {r["key"] for r in state("items").collect()} == {"s:a.md", "t:z.zip"}
    assert {r["key"] for r in collection.failures(state("events")).collect()} == {"s:b.md", "t:n.md"}
    again = files(("s", "a.md", b"changed"), ("s", "b.md", GOOD.encode()), ("t", "n.md", b"x"))
    collection.collect(spark, again, folder, "run-2")
    assert state("items").count() == 2
    before = collection.failures(state("events")).collect()
    collection.collect(spark, again, folder, "run-3", retry=True)
    collection.collect(spark, again, folder, "run-3", retry=True)
    assert {r["key"]: r["retry_count"] for r in collection.failures(state("events")).collect()} == {"t:n.md": 1}
    assert state("records").count() == 3 and state("records").select("id").distinct().count() == 3
    m = {r["source"]: r.asDict() for r in collection.manifest(first.select("source", "path"), state("items"), state("events")).collect()}
    assert (m["s"]["discovered"], m["s"]["processed"], m["s"]["failed"], m["s"]["complete"]) == (2, 2, 0, True)
    assert (m["t"]["processed"], m["t"]["failed"], m["t"]["records"]) == (1, 1, 1)
    audit = collection.recovery_audit(spark.createDataFrame([(r["key"],) for r in before], "key string"), state("items"), state("events"))
    assert {r["key"]: r["outcome"] for r in audit.collect()} == {"s:b.md": "recovered", "t:n.md": "failed"}


def test_extended_plan(spark):
    plan = spark.createDataFrame([("s", "a", 0), ("s", "b", 0)], "source string, path string, agent int")
    new = spark.createDataFrame([("s", p, "1") for p in "abcdef"], "source string, path string, revision string")
    pinned = spark.createDataFrame([("s", "1")], "source string, revision string")
    rows = collection.extended_plan(plan, new, pinned, 2, 2).collect()
    assert sorted(r["path"] for r in rows) == list("cdef") and sorted(r["agent"] for r in rows) == [0, 0, 1, 1]
    with pytest.raises(ValueError):
        collection.extended_plan(plan, new.withColumn("revision", F.lit("2")), pinned, 2, 2)


def test_git_tree(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@example.com", *a], check=True, capture_output=True)
    git("init", "-q")
    for k in range(5):
        (tmp_path / f"é {k}.md").write_text(f"{k}")
    git("add", ".")
    git("commit", "-qm", "x")
    (tmp_path / "é 0.md").write_text("later")
    spark.dataSource.register(gittree.GitTree)
    rows = spark.read.format("gittree").option("repository", str(tmp_path)).option("paths_per_task", "2").load().collect()
    assert {r["path"]: bytes(r["content"]) for r in rows} == {f"é {k}.md": str(k).encode() for k in range(5)}
