import subprocess

import pytest
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.operators import collection, meals, publish, search, site, tables
from weftline.sources import documents, gittree, rules, web


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


def test_merge_shards(spark):
    a = spark.createDataFrame([(1, None, "x"), (2, "same", None), (None, "n", "n")], "k int, a string, b string")
    b = spark.createDataFrame([(1, "x", None), (2, "same", None), (3, "new", "y")], "k int, a string, b string")
    merged, conflicts = tables.merge_shards([a, b, a.select("k", "a").where("k = 2")], "k")
    assert sorted(map(tuple, conflicts.collect())) == [(1, 2)]
    assert sorted(map(tuple, merged.collect()), key=str) == sorted([(2, "same", None), (3, "new", "y"), (None, "n", "n")], key=str)


def test_plans_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(tables, "MAX_UNITS", 2)
    units = spark.createDataFrame([("a", 5), ("b", 4), ("c", 3)], "u string, n int")
    with pytest.raises(ValueError, match="at most 2"):
        tables.least_loaded(units, "u", "n", 2)
    assert tables.least_loaded(units.limit(2), "u", "n", 2).count() == 2


def test_references(spark):
    page = "<p>1&frac12; cups &amp; &#233;&#x1F35E;&#0; &lt;b&gt;</p><script>if (a<b) x</script><style>p{}</style>&unknown; &amp;lt;"
    assert one(spark, tx.visible_text(F.col("a")), a=page) == "1½ cups & é🍞� <b> &unknown; &lt;"
    assert one(spark, tx.visible_text(F.col("a")), a="") == ""


def test_meals(spark):
    rows = spark.createDataFrame(
        [
            ("fruit pizza", ["flour"], ["grain"], "dessert"), ("fish cakes cookies", ["cod"], ["seafood"], "main"), ("Taco Seasoning", [], [], "component"),
            ("loaf", ["sugar", "flour", "vanilla"], ["baking"], "dessert"), ("loaf", ["sugar", "flour", "vanilla", "ham"], ["meat"], "main"), (None, None, None, "main"),
        ],
        "title string, names array<string>, categories array<string>, want string",
    )
    role = meals.practical_role(F.lit("main"), F.col("title"), F.col("names"), F.col("categories"), "(?i)cookies")
    assert all(r["want"] == r["r"] for r in rows.select("want", role.alias("r")).collect())
    items = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(q).cast("double").alias("quantity"), F.lit(u).alias("unit")) for n, q, u in (("butter", 0.1, "L"), ("olive oil", 20, "mL"), ("butter", 50, "g"), ("flour", 9, "mL"), ("butter", None, "mL"))))
    assert one(spark, meals.added_fat(items)) == 120.0
    assert [one(spark, meals.prominent_fat(F.lit(120.0), F.lit(s).cast("int"), 60, 20)) for s in (None, 0, 4, 8)] == [True, True, True, False]
    assert [one(spark, meals.score_label(F.lit(s))) for s in (95, 80, 79.9, 60, 0)] == ["Excellent", "Strong", "Good", "Usable", "Low priority"]
    issues = F.array(F.lit("explicit instruction duration exceeds total"), F.lit("no parsed instructions"))
    assert one(spark, meals.structural_issues(issues)) == ["no parsed instructions"]
    none = F.array().cast("array<string>")
    assert one(spark, meals.everyday_eligible(F.lit("Salad"), F.lit(True), none, F.lit("x"), none)) and not one(spark, meals.everyday_eligible(F.lit("Salad"), F.lit(None).cast("boolean"), none, F.lit("x"), none))


def test_labelled_times(spark):
    text = "# Soup\n**Prep time:** 1 hr 5 min\nCooking time\n\n2小时\nTotal time: ages\nReady in 90 minutes\nActive time: 0 min"
    got = one(spark, publish.labelled_times(F.col("a")), a=text)
    assert got.asDict() == {"active_minutes": None, "total_minutes": 90.0, "prep_minutes": 65.0, "cook_minutes": 120.0}
    assert set(one(spark, publish.labelled_times(F.lit(None).cast("string"))).asDict().values()) == {None}


def test_reextracted(spark):
    fields = "struct<title:string,ingredients:array<string>,instructions:array<string>>"
    rows = spark.createDataFrame([(("old", ["a"], ["b"]), ("new", ["c"], ["d"])), (("old", ["a"], ["b"]), ("new", [], ["d"])), (("old", ["a"], None), None)], f"r {fields}, p {fields}")
    out = rows.select(publish.reextracted(F.col("r"), F.col("p"), ["title", "ingredients"]).alias("x")).select("x.title", "x.reextracted").collect()
    assert [tuple(r) for r in out] == [("new", True), ("old", False), ("old", False)]


def test_published(spark):
    records = spark.createDataFrame([("a", "A", "s/", "r", 1, True, ["x"]), ("b", "B", "s/", None, 2, None, ["y"]), ("c", "C", "t", "r", 9, True, ["z"]), (None, "N", "t", "r", 9, True, ["z"])], "id string, title string, source string, revision string, raw_id int, allowed boolean, steps array<string>")
    matches = spark.createDataFrame([("a", 5.0, "ok")], "id string, score double, state string")
    members = spark.createDataFrame([("c", "a"), ("a", "a")], "id string, representative string")
    captured = spark.createDataFrame([(1, "Original")], "raw_id int, original_title string")
    sources = spark.createDataFrame([("s/", "docs/LICENSE 1.md")], "source string, license_path string")
    rows, withheld, alias = publish.published(records, matches, members, captured, sources)
    got = {r["id"]: r for r in rows.collect()}
    assert set(got) == {"a", "b"} and got["a"]["license_url"] == "s/blob/r/docs/LICENSE%201.md" and got["a"]["original_title"] == "Original"
    assert (got["b"]["steps"], got["b"]["state"], got["b"]["license_url"], got["b"]["original_title"]) == ([], "unknown", None, "B")
    assert [tuple(r) for r in withheld.collect()] == [("b",)] and [tuple(r) for r in alias.collect()] == [("c", "a")]


def test_search_vocabulary_and_urls(spark):
    item = "array<struct<canonical:string,terms:array<string>,aliases:array<string>>>"
    rows = spark.createDataFrame([(1, "Soup", [("Green Onion", ["2 green onions"], ["Scallion"])]), (2, "Pie", [("leek", None, None), ("", ["x"], None)]), (3, "None", None)], f"id int, title string, i {item}")
    terms, variants = search.prepare(rows, F.col("i"))
    assert {tuple(r) for r in terms.collect()} == {("green onion", "green onion"), ("2 green onions", "green onion"), ("leek", "leek")}
    parts = search.query_parts("green onion leek soup", terms, variants)
    assert [(p.phrase, p.canonical) for p in parts] == [("green onion", ("green onion",)), ("leek", ("leek",)), ("soup", ())] and parts[0].phrases == ("green onion", "scallion")
    assert search.query_parts("", terms, variants) == []
    state = ("a b&c", {"meal": "Salad"}, "time", 3)
    assert search.from_url("?" + search.to_url(*state), ["meal", "other"]) == state
    assert search.to_url("", {}) == "page=1" and search.from_url("page=x&q=", ["meal"]) == ("", {}, "default", 1)


def test_rules(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "r.yaml").write_text("ingredients:\n  garlic: {aliases: [cloves], category: vegetable, vegetable: true}\n  salt: [sea salt]\n  egg:\nscoring:\n  time: 20\n  balance: 30\n  rich: [0.3, 0.5]\n")
    told = rules.read_rules(spark, str(tmp_path / "r.yaml"))
    assert rules.entries(told) == {"garlic": ["cloves"], "salt": ["sea salt"], "egg": []}
    rows = {r["name"]: r for r in rules.vocabulary_rows(spark, told).collect()}
    assert rows["garlic"]["vegetable"] and rows["garlic"]["category"] == "vegetable" and rows["salt"]["aliases"] == ["sea salt"] and not rows["egg"]["protein"]
    w = rules.weights(told["scoring"])
    assert (w.time, w.balance, w.rich) == (20, 30, (0.3, 0.5))
    for bad in ({"time": 30}, {"speed": 1}):
        with pytest.raises(ValueError, match="weights"):
            rules.weights(bad)
    (tmp_path / "empty.yaml").write_text("")
    assert rules.read_rules(spark, str(tmp_path / "empty.yaml")) == {}


def test_owners_locks_and_final_states(spark, tmp_path):
    folder = str(tmp_path / "state")
    with collection.locked(spark, folder, "one"):
        with pytest.raises(ValueError, match="in use"), collection.locked(spark, folder, "one"):
            pass
        with pytest.raises(ValueError, match="another owner"):
            collection.claim(spark, folder, "two")
    with collection.locked(spark, folder, "one"):
        files = spark.createDataFrame([("s", "a.md", b"# A\n## Ingredients\n- x\n## Method\ny"), ("s", "b.md", b"nothing"), ("s", "c.zip", b"no archive")], "source string, path string, content binary")
        collection.collect(spark, files, folder, "r1")
    events = {r["path"]: r["retryable"] for r in collection.state(spark, folder, "events").collect()}
    assert events == {"b.md": False, "c.zip": True}
    assert [(r["event"], r["files"], r["failed"]) for r in collection.log_rows(spark, folder).collect()] == [("collected", 3, 2)]
    collection.finalize(spark, folder, "r1")
    for again in (lambda: collection.collect(spark, files, folder, "r2"), lambda: collection.finalize(spark, folder, "r2")):
        with pytest.raises(ValueError, match="final"):
            again()


def test_pages_are_replaced_in_one_step(spark, tmp_path):
    for html in ("old", "new"):
        site.write_files(spark.createDataFrame([("recipes/a.html", html)], "url string, html string"), str(tmp_path))
        assert (tmp_path / "recipes" / "a.html").read_text().strip() == html


def test_git_tree_in_one_process(spark, tmp_path):
    names = {"a.txt": b"one\n", "dir/b c.bin": bytes(range(256)), "empty": b"", "é.txt": b"x"}
    for name, data in names.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "-A")
    run("-c", "user.name=t", "-c", "user.email=t@example.com", "commit", "-qm", "x")
    spark.dataSource.register(gittree.GitTree)
    rows = spark.read.format("gittree").option("repository", str(tmp_path)).option("paths_per_task", "3").load().collect()
    assert {r["path"]: bytes(r["content"]) for r in rows} == names


def test_parser_says_what_may_be_tried_again():
    assert documents._parse_file("a.zip", b"no archive", None)[4] is True and documents._parse_file("a.md", b"", None)[4] is False
    assert documents._parse_file("a.txt.gz", b"no gzip", None)[4] is True


def test_fetch(spark):
    answers = {
        "https://a.example/robots.txt": (200, "User-agent: *\nDisallow: /no\nCrawl-delay: 0\n"), "https://a.example/x": (200, "<b>1 &eacute;</b>"), "https://a.example/no": (200, "never"),
        "https://b.example/robots.txt": (301, ""), "https://c.example/x": (429, ""), "https://c.example/y": (404, ""),
    }
    urls = spark.createDataFrame([(u,) for u in ("https://a.example/x", "https://a.example/x", "https://a.example/no", "https://b.example/x", "https://c.example/x", "https://c.example/y", "nonsense", None, "https://a.example/kept")], "u string")
    cache = spark.createDataFrame([("https://a.example/kept", "old")], "url string, body string")
    got = {r["url"]: (r["outcome"], r["body"], r["retryable"]) for r in web.fetch(urls, "u", web.replay(answers), "agent", cache).collect()}
    assert got == {
        "https://a.example/x": ("fetched", "<b>1 &eacute;</b>", False), "https://a.example/no": ("blocked", None, False), "https://b.example/x": ("blocked", None, False), "https://c.example/x": ("blocked", None, False),
        "https://c.example/y": ("failed", None, False), "nonsense": ("failed", None, False), "https://a.example/kept": ("cached", "old", False),
    }

    def broken(url):
        raise OSError("down")

    assert {(r["outcome"], r["retryable"]) for r in web.fetch(urls.where("u like '%x'"), "u", broken, "agent").collect()} == {("failed", True)}
    assert web.fetch(urls.where("false"), "u", broken, "agent").count() == 0
    fields = web.page_fields(spark.createDataFrame([("<b>1 &eacute;</b>",), ("",), (None,)], "h string"), "h", {"b": "<b>([^<]+)"}).collect()
    assert [r["b"] for r in fields] == ["1 é", None, None]


@pytest.mark.parametrize("identity", web.IDENTITIES)
def test_an_agent_of_ones_own_is_no_way_round_a_denial(spark, identity):
    rules = f"User-agent: *\nAllow: /\n\nUser-agent: {identity}\nDisallow: /private\nCrawl-delay: 1\n"
    client = web.replay({"https://a.example/robots.txt": (200, rules), "https://a.example/private/x": (200, "no"), "https://a.example/open": (200, "yes")})
    site = web._Origin("https://a.example", client, "own-agent", 0.0)
    assert site.interval == 1
    site.interval = 0
    assert site.get("https://a.example/private/x", client)[0] == "blocked"
    assert site.get("https://a.example/open", client)[:3] == ("fetched", 200, "yes")


def test_labelled_times_read_references(spark):
    for text, want in (("Total time:&nbsp;30 min", 30), ("Total time: 30 min", 30), ("Total&#32;time:\u00a01&nbsp;hr&#x20;5 min", 65), ("x&#10;Ready in&#10;&#10;20 minutes", 20), ("&lt;b&gt;Total time: 5 min", None)):
        assert one(spark, publish.labelled_times(F.col("a")), a=text)["total_minutes"] == want, text


def test_class_members_of_patterns_are_literal():
    import re

    from weftline.functions.text import glob_regex

    for pattern, yes, no in (("[[a]", "[", "b"), ("[^a]", "^", "b"), ("[!&&a]x", "bx", "&x"), ("a.b", "a.b", "a.b\n")):
        found = re.compile(glob_regex(pattern).replace("\\z", "\\Z"))
        assert found.search(yes) and not found.search(no), pattern
