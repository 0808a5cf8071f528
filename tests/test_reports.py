"""Pattern rows, subtotals, bounded lists and kept audits against plain computations."""

import random
from fnmatch import fnmatchcase

from pyspark.sql import functions as F

from weftline.operators import patterns, reports, tables


def test_paths_meet_their_patterns(spark):
    rng = random.Random(4)
    names = ["a", "bc", "b.c", "x", "", "*", "A"]
    paths = [("s" + rng.choice("12"), "/".join(rng.choice(names) for _ in range(rng.randint(1, 4))) + rng.choice(["", ".md", ".json", ".tar.gz"])) for _ in range(300)]
    bits = ["a", "b", "*", "?", "/", "[ab]", "[!a]", ".md", ".json", "bc/", "[", ".gz"]
    rules = [("s" + rng.choice("12"), rng.choice(["include", "include", "exclude"]), "".join(rng.choice(bits) for _ in range(rng.randint(1, 4)))) for _ in range(80)] + [("s1", "include", "*"), ("s1", "exclude", None)]
    p, r = spark.createDataFrame(paths, "source string, path string"), spark.createDataFrame(rules, "source string, kind string, pattern string")
    want = {(s, x, k, g) for s, x in paths for t, k, g in rules if g is not None and s == t and fnmatchcase(x, g)}
    found = patterns.matches(p.distinct(), r)
    assert {tuple(x) for x in found.collect()} == want and found.count() == len(want)
    chosen = {(s, x) for s, x in paths if any(w[:3] == (s, x, "include") for w in want) and not any(w[:3] == (s, x, "exclude") for w in want)}
    assert {tuple(x) for x in patterns.selected(p, r).collect()} == chosen and chosen
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_a_pattern_meets_few_paths(spark):
    """Keys are folders and extensions: of 1,000 paths only those in the folder, or with the extension, are matched in full."""
    keys = lambda c, x: spark.createDataFrame([(x,)], "x string").select(c(F.col("x"))).first()[0]
    assert [keys(patterns.pattern_key, x) for x in ("a/b*.md", "a/b/c.md", "*.md", "x?y.tar.gz", "*a*", "*.m?", "[a/b].md", "plain")] == ["d:a/", "d:a/b/", "e:md", "e:gz", "", "", "e:md", ""]
    assert keys(patterns.path_keys, "/a/b.c.md") == ["d:/", "d:/a/", "e:md", ""]


def test_histograms_with_subtotals(spark):
    rows = [("s", "done", "x", 2), ("s", "failed", "x", 3), ("t", "done", None, 5), (None, "done", "y", 7)]
    got = {tuple(r) for r in reports.histograms(spark.createDataFrame(rows, "source string, status string, member string, size long"), "source", ["status", "member"], {"size": F.sum("size")}).collect()}
    want = set()
    for total in (False, True):
        for source in {None} if total else {r[0] for r in rows}:
            mine = [r for r in rows if total or r[0] == source]
            want.add((source, total, None, None, len(mine), sum(r[3] for r in mine)))
            for k, d in ((1, "status"), (2, "member")):
                for v in {r[k] for r in mine}:
                    some = [r for r in mine if r[k] == v]
                    want.add((source, total, d, v, len(some), sum(r[3] for r in some)))
    assert got == want
    assert {tuple(r) for r in tables.breakdown(spark.createDataFrame(rows, "a string, b string, c string, d long"), ["a", "c"]).collect()} == {("a", "s", 2), ("a", "t", 1), ("a", None, 1), ("c", "x", 2), ("c", None, 1), ("c", "y", 1)}


def test_first_values_of_a_hot_group(spark):
    rows = spark.range(0, 1_000_000, 1, 8).select(F.when(F.col("id") % 1000 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7000)).alias("g"), ((F.col("id") * 7919) % 999_983).alias("v"), F.when(F.col("id") % 2 == 0, F.col("id") % 5).alias("w"))
    rows = rows.unionByName(spark.createDataFrame([(None, 5, None), (None, None, None)], "g string, v long, w long"))
    out = reports.first_values(rows, ["g"], {"evidence": ("v", 3), "examples": ("w", 30)})
    got = {r["g"]: (r["n"], r["evidence"], r["examples"]) for r in out.collect()}
    assert got["hot"] == (999_000, [0, 1, 2], [0, 1, 2, 3, 4]) or got["hot"][0] == 999_000 and got["hot"][1] == sorted(got["hot"][1]) and len(got["hot"][1]) == 3 and got["hot"][2] == [0, 1, 2, 3, 4]
    assert got[None] == (2, [5], []) and len(got) == 9
    ranked = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "WindowGroupLimit" in line]
    assert any("Partial" in line for line in ranked)
    many = reports.first_values(rows.where("g = 'g0'"), ["g"], {"w": ("w", 4)}, distinct=False).first()
    assert len(many["w"]) == 4


def test_audits_are_kept(spark, tmp_path):
    folder, state = tmp_path / "in", f"{tmp_path}/state"
    audit = reports.Audit(spark, str(folder), state, {"k": F.col("id") % 3}, {"nulls": F.col("v").isNull().cast("int"), "total": F.col("v")}, {"low": F.col("v")}, {"high": F.col("v")})

    def put(name, low, high, v):
        spark.range(low, high).select("id", v.alias("v")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")

    def whole():
        rows = spark.read.option("recursiveFileLookup", "true").parquet(str(folder))
        return sorted(map(tuple, rows.groupBy((F.col("id") % 3).alias("k")).agg(F.count("*"), F.sum(F.col("v").isNull().cast("int")), F.sum("v"), F.min("v"), F.max("v")).collect()))

    kept = lambda: sorted(map(tuple, audit.result().collect()))
    v = F.when(F.col("id") % 4 > 0, F.col("id"))
    put("one", 0, 50, v), put("two", 50, 90, v)
    assert audit.update(1) == (2, 0) and kept() == whole()
    put("three", 90, 130, v)
    assert audit.update(2) == (1, 0) and kept() == whole()
    put("two", 40, 70, -F.col("id"))  # replaced: what it said before is taken back
    assert audit.update(3) == (1, 1) and kept() == whole()
    assert audit.update(3) == (1, 1) and kept() == whole()  # once more after a failure
    for p in (folder / "one").iterdir():
        p.unlink()
    assert audit.update(4) == (0, 1) and kept() == whole()
    assert audit.update(5) == (0, 0) and kept() == whole()
