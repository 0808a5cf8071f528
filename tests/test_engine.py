"""Operators on inline fixtures, and every registered query against its SQL on the smallest tables."""

import datetime
import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from weftline import queries as core
from weftline.functions import identity, ingredients, measure
from weftline.functions import text as tx
from weftline.operators import classify, evidence, publish, scoring, search, tables
from weftline.sources import jsonl
from weftline.streaming import ingest

DATA = "/root/testdata/sf0.001"


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


METRIC = [
    ("Bake at 350°F with 2 tablespoons oil", "Bake at 176.667 °C with 30 mL oil"), ("Bake at 350F.", "Bake at 176.667 °C."), ("1 c. à soupe huile", "15 mL huile"), ("2 TL Salz", "10 mL Salz"),
    ("1 κ.σ. ελαιόλαδο", "15 mL ελαιόλαδο"), ("Cup4Cup flour", "Cup4Cup flour"), ("Cup-4-Cup flour", "Cup-4-Cup flour"), ("2-4 tbsp oil", "30–60 mL oil"), ("1 1/2-tablespoon scoop", "22.5 mL scoop"),
    ("16-oz. mason jar", "mason jar (check source capacity)"), ("1 tbspbaking powder", "15 mL baking powder"), ("⅗ cup water", "144 mL water"), (".5 tbsp olive oil", "7.5 mL olive oil"), ("3 pounds beef", "1360.78 g beef"),
]


def test_metric_text(spark):
    rows = spark.createDataFrame(METRIC, "a string, b string").select("a", "b", measure.metric_text(F.col("a")).alias("c")).collect()
    assert [(r["a"], r["c"]) for r in rows] == [(a, b) for a, b in METRIC]


def test_numbers_and_times(spark):
    rows = spark.createDataFrame([("1 1/2", 1.5), ("3/4", 0.75), ("2.5", 2.5), ("1/0", None), ("x", None)], "a string, b double").select("b", measure.number(F.col("a")).alias("c")).collect()
    assert all(r["b"] == r["c"] for r in rows)
    rows = spark.createDataFrame([("PT1H30M", 90.0), ("45 min", 45.0), ("PT30S", 0.5), ("soon", None)], "a string, b double").select("b", measure.iso_minutes(F.col("a")).alias("c")).collect()
    assert all(r["b"] == r["c"] for r in rows)
    t = measure.timing(F.col("s"), F.lit(20))
    cases = [(["Simmer for 40 minutes."], (40.0, False, True)), (["Store leftovers for 3 days."], (None, False, False)), (["Make this 2 days before."], (2880.0, True, True)), ([], (None, False, False))]
    rows = spark.createDataFrame([(s,) for s, _ in cases], "s array<string>").select(t.alias("t")).collect()
    assert [tuple(r["t"]) for r in rows] == [c for _, c in cases]


VOCABULARY = {"tomato": ["roma tomatoes"], "olive oil": ["EVOO"], "soy sauce": [], "sugar": ["白砂糖"], "salt": [], "chickpea": ["chickpeas"], "chicken breast": ["鸡胸肉"], "garlic": ["大蒜"], "flour": [], "water": [], "kidney bean": ["dark kidney beans"]}
ITEMS = [
    ("2 tbsp olive oil", "olive oil", 30, "mL"), ("1 1/2 cups water", "water", 360, "mL"), ("½ kg chicken", "chicken", 0.5, "kg"), ("1½ tbsp oil", "oil", 22.5, "mL"), ("2 oz flour", "flour", 56.699, "g"), ("2 roma tomatoes", "tomato", 2, None),
    ("30 mL EVOO", "olive oil", 30, "mL"), ("白砂糖 30 g", "sugar", 30, "g"), ("2 tbsp [olive oil](https://x.example/)", "olive oil", 30, "mL"), ("**15** g olive oil", "olive oil", 15, "g"), ("1/4 tsp salt, (divided)", "salt", 1.25, "mL"),
    ("2 (15 oz) cans chickpeas, (drained and rinsed)", "chickpea", 2, None), ("鸡胸肉 = 300g", "chicken breast", 300, "g"), ("大蒜 = 2瓣", "garlic", 2, None), ("2 – 16oz can dark kidney beans", "kidney bean", 2, None),
]


def test_ingredient_lines(spark):
    rows = ingredients.parse_items(spark.createDataFrame([(a,) for a, *_ in ITEMS], "a string"), "a", VOCABULARY, "i").collect()
    assert [(r["a"], r["i"]["canonical"], r["i"]["quantity"], r["i"]["unit"]) for r in rows] == ITEMS
    by = {r["a"]: r["i"] for r in rows}
    assert by["2 – 16oz can dark kidney beans"]["package"]["quantity"] == 453.592 and by["大蒜 = 2瓣"]["count_unit"] == "瓣"


def test_ingredient_details(spark):
    entries = VOCABULARY | {"butter": [], "garlic": ["garlic cloves"], "chicken": []}
    want = {
        "2 tbsp soy sauce (optional)": {"optional": True, "display": "30 mL soy sauce (optional)", "quantity": 30.0, "original_unit": "tbsp", "original_quantity": "2"},
        "16-oz. mason jar": {"quantity": None, "display": "mason jar (check source capacity)"},
        "garlic (minced)": {"canonical": "garlic (minced)", "method": "unresolved-name"},
        "garlic (finely chopped)": {"canonical": "garlic", "method": "explicit-alias"},
        "3 garlic cloves, minced": {"canonical": "garlic", "quantity": 3.0, "unit": None},
        "melted tablespoon butter": {"canonical": "melted 15 mL measure butter"},
        "1 finely chopped large chicken, at room temperature": {"canonical": "chicken"},
        "2-3 cups water": {"quantity": 480.0, "quantity_max": 720.0, "unit": "mL"},
        "3 slices of butter": {"canonical": "butter", "count_unit": "slices", "quantity": 3.0},
        "½ kg chicken": {"quantity": 0.5, "unit": "kg", "canonical": "chicken"},
        "**15** g olive oil": {"quantity": 15.0, "unit": "g"},
        "1/0 cup x": {"quantity": None, "unit": "mL"},
        "Salt, to taste": {"canonical": "salt", "quantity": None},
        "2 cups ｗater": {"canonical": "water"},
        "": {"canonical": "", "display": "", "quantity": None},
        None: {"canonical": "", "original_text": None},
    }
    lines = spark.createDataFrame([(x, 1) for x in want], "a string, item int")
    for r in ingredients.parse_items(lines, "a", entries).collect():
        for field, value in want[r["a"]].items():
            assert r["item"][field] == value, (r["a"], field, r["item"][field])
    names = spark.createDataFrame([("Large chicken (drained)",), ("GARLIC cloves",), ("odd, diced thing",), (None,)], "n string")
    mapped = {r["n"]: r["canonical"] for r in ingredients.canonical_names(names, "n", entries).collect()}
    spellings = spark.createDataFrame(list(ingredients.vocabulary(entries).items()), "spelling string, canonical string")
    joined = {r["n"]: r["canonical"] for r in ingredients.resolve_names(names, "n", spellings).collect()}
    assert mapped == joined | {None: None} == {"Large chicken (drained)": "chicken", "GARLIC cloves": "garlic", "odd, diced thing": "odd", None: None}


def test_identity(spark):
    assert one(spark, identity.stable_id(F.col("a"), F.col("b")), a="x", b='é"') == __import__("hashlib").sha256('["x", "é\\""]'.encode()).hexdigest()[:24]
    rows = spark.createDataFrame([("t", ["b", "a"], ["s"]), ("t", ["a", "b"], ["s"]), ("t", ["a", "b"], ["s", "u"])], "t string, i array<string>, s array<string>")
    f = identity.content_fingerprint(F.col("t"), F.lit(None).cast("string"), F.transform("i", lambda x: F.struct(x.alias("n"))), F.col("s"))
    a, b, c = (r[0] for r in rows.select(f).collect())
    assert a == b != c


def test_tri_state(spark):
    rows = spark.createDataFrame([(1, True), (1, None), (2, False), (2, None), (3, False), (3, False), (4, None)], "k int, v boolean").groupBy("k").agg(evidence.any_known(F.col("v")).alias("v")).collect()
    assert {r["k"]: r["v"] for r in rows} == {1: True, 2: None, 3: False, 4: None}


def test_inventory_with_two_first_rows_and_nulls(spark, tmp_path):
    """Rows of one part with the same place: the first in the files counts, as in SQL. Nulls are passed over."""
    names = "l_partkey long, l_suppkey long, l_returnflag string, l_orderkey long, l_linenumber int, l_linestatus string"
    rows = [(k, 10 * k + j, "ANR"[j % 3], 1, 1, "FO"[(k + j) % 2]) for k in range(40) for j in range(4)]
    rows += [(90, 1, "R", 2, 1, None), (90, 2, None, 3, 1, "F"), (91, None, None, 5, None, "O"), (92, None, "R", None, 1, "O"), (92, 3, "N", 4, 2, "F"), (None, 7, "R", 6, 1, "F")]
    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    con = duckdb.connect(config={"threads": 1})  # with more, ties in SQL differ from run to run
    for k in range(2):  # later rows in another file
        half = spark.createDataFrame([r for j, r in enumerate(rows) if (j % 4 >= 2) == bool(k)], names)
        half.coalesce(1).toPandas().astype({c: "Int64" for c in ("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")}).to_parquet(folder / f"part-{k}.parquet", index=False)
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{folder}/*.parquet')")
    want = con.execute(core.ORACLE_SQL["tri_state_inventory"])
    columns = [c[0] for c in want.description]
    want = {r[0]: r for r in want.fetchall()}
    got = {r["l_partkey"]: tuple(r[c] for c in columns) for r in core.QUERIES["tri_state_inventory"](spark, str(tmp_path)).collect()}
    assert got == want
    assert [got[k][-1] for k in (0, 1, 90, 91, 92)] == ["F", "O", "F", None, "F"] and got[90][1] is False and got[91][2] is None


def test_text(spark):
    assert one(spark, tx.clean_name(F.col("a")), a=" **Ｏlive   Oil**,. ") == "olive oil"
    assert one(spark, tx.display_title(F.col("a")), a="红烧肉的做法") == "红烧肉" and one(spark, tx.display_title(F.col("a")), a="三种做法") == "三种做法"
    assert one(spark, tx.safe_url(F.col("a"), F.col("b")), a="https://u@x.example/", b="http://ok.example/p") == "http://ok.example/p"
    assert one(spark, tx.labels(F.col("a"), {"italian": "Italian", "iberian": "Spanish,Portuguese"}), a="ITALIAN, iberian, x") == ["Italian", "Portuguese", "Spanish"]
    assert one(spark, tx.path_selected(F.col("a"), ["docs/*.md"], ["*README*"]), a="docs/x/y.md") is True


def test_classify(spark):
    t = classify.triage(F.col("a"), F.col("b"))
    cases = [("Access denied", "x.md", "BLOCKED"), ("# Title\nTODO", "x.md", "NOT_A_RECIPE_SOURCE"), ("# A\n## Ingredients\n- x\nlots", "x.md", "LEGITIMATE_RECIPE_FAILURE"), ("A long story.", "x.md", "UNSUPPORTED"), ("<p>hello</p>", "x.html", "UNSUPPORTED")]
    for a, b, want in cases:
        assert one(spark, t, a=a, b=b)["outcome"] == want
    kind = classify.meal_type(F.lit("unknown"), F.col("a"), F.lit(True), F.lit(False), F.lit(False), F.lit(True))
    assert one(spark, kind, a="Chili pepper eggs") == "Breakfast" and one(spark, kind, a="Beef chili") == "Soup/stew"


def test_scores(spark):
    w = scoring.Weights()
    full = scoring.compatibility_score(F.lit(1.0), F.lit(None).cast("double"), F.lit(False), F.lit(False), w)
    assert one(spark, full, a=1) == 35
    assert math.isclose(one(spark, scoring.time_score(F.lit(None).cast("double"), F.lit(15.0), F.lit("Easy"), F.lit(False), w), a=1), 25)
    with pytest.raises(ValueError):
        scoring.Weights(time=30)


def test_search(spark):
    rows = spark.createDataFrame([("both", "stew", ["chicken", "mushroom"]), ("exact", "mushroom", ["x"]), ("part", "mushroom soup", ["x"]), ("one", "pie", ["mushroom"]), ("no", "cake", ["egg"])], "id string, t string, i array<string>")
    rows = rows.withColumn("items", F.transform("i", lambda x: F.struct(x.alias("canonical"), F.array(x).alias("terms"))))
    found = search.rank(rows, search.parse_query(["mushroom"], {}, {}), [F.col("t")], F.col("items"), F.col("t")).collect()
    assert {r["id"]: r["priority"] for r in found} == {"exact": 0, "part": 1, "both": 2, "one": 2}
    parts = search.parse_query(["green", "onion", "soup"], {"green onion": {"scallion"}}, {"scallion": {"scallion", "spring onion"}})
    assert [p.phrase for p in parts] == ["green onion", "soup"] and parts[0].phrases == ("green onion", "scallion", "spring onion")


def test_publish(spark):
    rows = spark.createDataFrame([(1, ["2 tbsp oil"], "http://x/2 tbsp", True), (2, ["y"], None, None)], "id int, steps array<string>, url string, ok boolean")
    out = publish.publish(rows, ["id", "steps", "url"], rewrite=measure.metric_text, skip=("url",), redact={"steps": F.col("ok")}).orderBy("id").collect()
    assert [tuple(r) for r in out] == [(1, ["30 mL oil"], "http://x/2 tbsp"), (2, [], None)]


def test_plan(spark):
    units = spark.createDataFrame([("a", 5), ("b", 4), ("c", 3), ("d", 3)], "u string, n int")
    assert {r["u"]: r["bin"] for r in tables.least_loaded(units, "u", "n", 2).collect()} == {"a": 0, "b": 1, "c": 1, "d": 0}


def test_jsonl(spark, tmp_path):
    rows = spark.createDataFrame([(2, "a b"), (1, None)], "k int, t string")
    jsonl.write_jsonl(rows, str(tmp_path / "x"), order=["k"])
    back = jsonl.read_jsonl(spark, str(tmp_path / "x"), "k int, t string")
    assert sorted(map(tuple, back.collect())) == [(1, None), (2, "a b")]
    assert jsonl.read_jsonl(spark, str(tmp_path / "none"), "k int").count() == 0


def test_ingest_is_idempotent(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    schema = "k bigint, v string"
    spark.createDataFrame([(1, "a"), (2, "b")], schema).write.parquet(source)
    ingest.ingest(spark, source, schema, target, mark, "k")
    spark.createDataFrame([(2, "changed"), (3, "c")], schema).write.mode("append").parquet(source)
    ingest.ingest(spark, source, schema, target, mark, "k")
    ingest.ingest(spark, source, schema, target, mark, "k")
    assert sorted(map(tuple, ingest.ingested(spark, target, schema).collect())) == [(1, "a"), (2, "b"), (3, "c")]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return str(v) if isinstance(v, datetime.date) else v


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(core.ORACLE_SQL[name])
    df = core.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
