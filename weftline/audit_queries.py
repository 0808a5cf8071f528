"""Registered queries that reach every branch of scores, explanations, audits and collection reports, with faults to find."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import identity, measure
from .index_queries import ORACLE_SQL, QUERIES, query, table  # noqa: F401
from .operators import classify, collection, meals, publish, scoring, signals, validation
from .operators.storage import shared

@query("""WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderkey % 130 AS DOUBLE) END AS active, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey % 150 AS DOUBLE) END AS total, ['Easy', 'Moderate', 'Involved'][CAST(o_orderkey % 3 AS INTEGER) + 1] AS effort FROM orders),
f AS (SELECT *, CASE effort WHEN 'Easy' THEN 0.8 WHEN 'Moderate' THEN 0.65 ELSE 0.45 END AS est, CASE WHEN active <= 15 THEN 1.0 WHEN active <= 30 THEN 0.8 WHEN active <= 45 THEN 0.6 WHEN active IS NOT NULL THEN 0.4 END AS a,
  CASE WHEN total <= 30 THEN 1.0 WHEN total <= 45 THEN 0.9 WHEN total <= 60 THEN 0.75 WHEN total <= 120 THEN 0.5 WHEN total IS NOT NULL THEN 0.3 END AS t FROM o)
SELECT k AS o_orderkey, round(CAST(25 * CASE WHEN active IS NULL AND total IS NULL THEN least(0.75, est) ELSE 0.65 * CASE WHEN active IS NULL AND total <= 15 AND effort = 'Easy' THEN 1.0 ELSE coalesce(a, est) END + 0.35 * coalesce(t, 0.75) END * CASE WHEN k % 7 = 0 THEN 0.7 ELSE 1 END AS DOUBLE), 9) AS time,
  round(CAST(25 * (0.45 * (k % 2 = 0)::INT + 0.35 * (k % 3 = 0)::INT + 0.15 * (k % 5 = 0)::INT + 0.05 * (k % 6 = 0)::INT) * CASE WHEN (k % 7) / 10.0 >= 0.25 THEN 0.7 ELSE 1 END * CASE WHEN (k % 9) / 10.0 >= 0.35 THEN 0.75 ELSE 1 END * CASE WHEN k % 8 = 0 THEN 0.85 ELSE 1 END AS DOUBLE), 9) AS balance,
  round(CAST(15 * (0.4 * greatest(0, least(1, (22 - k % 30) / 14.0)) + 0.35 * greatest(0, least(1, (18 - k % 25) / 12.0)) + 0.2 * CASE WHEN k % 11 = 0 THEN 1 ELSE greatest(0.3, 0.9 - 0.15 * (k % 6)) END + 0.05 * CASE WHEN k % 6 >= 4 THEN 1 ELSE 0.5 END) AS DOUBLE), 9) AS simplicity FROM f""")
def score_parts(spark, d):
    """Time, balance and simplicity over known and unknown times, all efforts, and every cut."""
    k, w = F.col("o_orderkey"), scoring.Weights()
    active, total = F.when(k % 5 > 0, (k % 130).cast("double")), F.when(k % 4 > 0, (k % 150).cast("double"))
    effort = F.when(k % 3 == 0, "Easy").when(k % 3 == 1, "Moderate").otherwise("Involved")
    time = scoring.time_score(active, total, effort, k % 7 == 0, w)
    balance = scoring.balance_score(k % 2 == 0, k % 3 == 0, k % 5 == 0, (k % 7) / 10, (k % 9) / 10, k % 8 == 0, w)
    simplicity = scoring.simplicity_score(k % 30, k % 25, k % 6, k % 11 == 0, F.when(k % 6 > 0, k % 6), w)
    return table(spark, d, "orders").select("o_orderkey", *(F.round(c, 9).alias(n) for n, c in (("time", time), ("balance", balance), ("simplicity", simplicity))))


@query("""WITH o AS (SELECT o_orderkey AS k, (o_orderkey % 10) / 10.0 AS coverage, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 40 END AS active, o_orderkey % 60 AS total FROM orders)
SELECT k AS o_orderkey, array_to_string(list_filter([CASE WHEN k % 11 = 0 THEN 'Check the main ingredient choice for your Fresh shop' END, CASE WHEN k % 13 = 0 THEN 'Uses a substantial amount of added cooking fat' END,
CASE WHEN coverage >= 0.85 THEN 'Ingredients generally sold at Fresh' WHEN coverage >= 0.7 THEN 'Most ingredients fit Fresh' ELSE 'Some ingredient choices may need checking' END,
CASE WHEN active <= 15 THEN 'At most 15 minutes of active work' WHEN total <= 30 THEN 'Ready within 30 minutes' WHEN active IS NULL THEN 'Active time not listed; effort estimated from recipe steps' END,
CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN 'Protein and vegetables' WHEN k % 2 = 0 THEN 'Includes a protein source' END, CASE WHEN k % 5 = 0 THEN 'Includes a staple food' END, CASE WHEN k % 3 > 0 THEN 'Simple cooking method and cleanup' END,
CASE WHEN k % 6 >= 4 THEN 'Makes several servings' END, CASE WHEN k % 17 = 0 THEN 'Plan ahead for preparation or resting' END, CASE WHEN k % 7 = 0 THEN 'Check the original recipe before cooking' END], lambda x: x IS NOT NULL), '|') AS reasons,
CASE WHEN k % 19 = 0 OR k % 20 > 14 OR k % 30 > 20 OR coalesce(active > 45, false) THEN 'Involved' WHEN k % 20 <= 8 AND k % 30 <= 12 AND k % 5 <= 2 AND coalesce(active <= 15, true) THEN 'Easy' ELSE 'Moderate' END AS effort FROM o""")  # fmt: skip
def explained_in_full(spark, d):
    """Every reason that a record can have, and its effort."""
    k = F.col("o_orderkey")
    active = F.when(k % 4 > 0, k % 40)
    easy = meals.easy_cleanup(F.when(k % 3 == 0, F.array(F.lit("fried"))).when(k % 3 == 1, F.array(F.lit("fried"), F.lit("one-pan"))).otherwise(F.array(F.lit("no-cook"))))
    why = meals.explanation(k % 11 == 0, k % 13 == 0, (k % 10) / 10, active, k % 60, k % 2 == 0, k % 3 == 0, k % 5 == 0, easy, k % 6 >= 4, k % 17 == 0, k % 7 == 0, market="Fresh")
    effort = classify.effort(k % 19 == 0, k % 20, k % 30, k % 5, active)
    return table(spark, d, "orders").select("o_orderkey", F.array_join(why, "|").alias("reasons"), effort.alias("effort"))


@query("""SELECT 'record missing from the index' AS "check", CAST(p_partkey AS VARCHAR) AS key FROM part WHERE p_partkey % 90 = 1 UNION ALL SELECT 'index entry without record', '-' || p_partkey FROM part WHERE p_partkey % 90 = 2
UNION ALL SELECT 'several entries', CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 90 = 3 UNION ALL SELECT 'entry without page', 'r/' || p_partkey FROM part WHERE p_partkey % 90 = 4
UNION ALL SELECT 'entry without page', 'r/-' || p_partkey FROM part WHERE p_partkey % 90 = 2 UNION ALL SELECT 'forbidden unit on a page', CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 90 = 5
UNION ALL SELECT 'page without sections', CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 90 = 6 UNION ALL SELECT 'step missing from a page', CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 90 = 7""")
def site_faults(spark, d):
    """A catalog with one fault of every kind for each 90 records."""
    k = F.col("p_partkey")
    of = lambda *n: (k % 90).isin(*n)
    parts = table(spark, d, "part").select(k, k.cast("string").alias("id"), F.concat(F.lit("Mix <"), "p_name", F.lit(">")).alias("step"))
    records = parts.select("id", F.col("id").alias("representative"), F.array("step").alias("steps"))
    entry = F.struct("id", F.concat(F.lit("r/"), "id").alias("url"))
    odd = F.struct(F.concat(F.lit("-"), "id").alias("id"), F.concat(F.lit("r/-"), "id").alias("url"))
    some = F.when(of(1), F.array().cast("array<struct<id:string,url:string>>")).when(of(2), F.array(entry, odd)).when(of(3), F.array(entry, entry)).otherwise(F.array(entry))
    sections, step = F.when(of(6), "").otherwise("<h2>Ingredients</h2><h2>Instructions</h2>"), F.when(of(7), "").otherwise(F.concat(F.lit("Mix &lt;"), F.regexp_extract("step", "<(.*)>", 1), F.lit("&gt;")))
    html = F.concat(sections, step)
    pages = parts.where(~of(4)).select("id", F.concat(F.lit("r/"), "id").alias("url"), html.alias("html"), of(5).alias("forbidden"))
    return validation.catalog_faults(parts.select(F.explode(some).alias("e")).select("e.*"), pages, records)


@query("""WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey % 200 AS k, o_orderkey FROM orders)
SELECT 'normalized without raw' AS "check", 'x' || id AS key FROM o WHERE k = 1 UNION ALL SELECT 'raw without provenance', id FROM o WHERE k = 2 UNION ALL SELECT 'match without record', 'm' || id FROM o WHERE k = 3 UNION ALL SELECT 'record without match', id FROM o WHERE k = 4
UNION ALL SELECT 'several matches', id FROM o WHERE k = 5 UNION ALL SELECT 'id in several files', id FROM o WHERE k = 6 UNION ALL SELECT 'unaccounted file', 'f' || id FROM o WHERE k = 7 UNION ALL SELECT 'processed and failed', 'f' || id FROM o WHERE k = 8""")
def pipeline_faults(spark, d):
    """A run's tables with one fault of every kind for each 200 records."""
    k = F.col("k")
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), (F.col("o_orderkey") % 200).alias("k"))
    two = lambda extra, when: F.explode(F.when(when, F.array(F.col("id"), extra)).otherwise(F.array("id")))
    key = F.concat(F.lit("f"), "id")
    raw = o.select("id", F.when(k != 2, F.lit("s")).alias("source"), F.lit("p").alias("path"), F.explode(F.when(k == 6, F.array(key, F.concat(key, F.lit("b")))).otherwise(F.array(key))).alias("key"))
    normalized = o.select("id", F.when(k == 1, F.concat(F.lit("x"), "id")).otherwise(F.col("id")).alias("raw_id"))
    matches = o.where(k != 4).select(two(F.concat(F.lit("m"), "id"), k == 3).alias("id")).unionByName(o.where(k == 5).select("id"))
    items, failed = o.where(k != 7).select(key.alias("key")), o.where(k == 8).select(key.alias("key"))
    return validation.pipeline_faults(raw, normalized, matches, items, failed, o.select(key.alias("key")))


_RUNS = """e AS (SELECT o_orderpriority AS source, CAST(o_orderkey AS VARCHAR) AS path, o_orderkey AS k FROM orders)"""


def _collected(spark, d):
    """discovered, items and events of two runs: every fifth file failed in the first, every tenth again in the second, some files are pending."""
    k = F.col("k")
    e = table(spark, d, "orders").select(F.col("o_orderpriority").alias("source"), F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderkey").alias("k"))
    e = e.withColumn("key", F.concat_ws(":", "source", "path"))
    items = e.where("k % 7 > 0 and k % 10 > 0").select("key", (k % 4).cast("int").alias("n_records"))
    event = lambda rows, run, what: rows.select("key", "source", "path", F.lit(what).alias("event"), F.concat(F.lit("no layout in "), F.lit(run)).alias("error"), F.lit(0).alias("retry_count"), F.lit(True).alias("retryable"), F.lit(None).cast("string").alias("classification"), F.lit(run).alias("run"))
    events = event(e.where("k % 5 = 0"), "r1", "failure").unionByName(event(e.where("k % 10 = 0"), "r2", "failure")).unionByName(event(e.where("k % 5 = 0 and k % 10 > 0"), "r2", "resolved"))
    return e, items, events


@query(f"""WITH {_RUNS} SELECT source, count(*) AS discovered, count(*) FILTER (k % 7 > 0 AND k % 10 > 0) AS processed, count(*) FILTER (k % 10 = 0) AS failed, CAST(coalesce(sum(k % 4) FILTER (k % 7 > 0 AND k % 10 > 0), 0) AS BIGINT) AS records,
count(*) FILTER (k % 7 = 0 AND k % 10 > 0) AS pending, count(*) FILTER (k % 7 = 0 AND k % 10 > 0) = 0 AS complete FROM e GROUP BY source""")
def collection_manifest(spark, d):
    e, items, events = _collected(spark, d)
    return collection.manifest(e, items, events)


@query(f"""WITH {_RUNS} SELECT source || ':' || path AS key, CASE WHEN k % 10 = 0 THEN 'failed' WHEN k % 7 = 0 THEN 'pending' ELSE 'recovered' END AS outcome, CASE WHEN k % 10 = 0 THEN 'no layout in r2' END AS error FROM e WHERE k % 5 = 0""")
def recovery_outcomes(spark, d):
    e, items, events = _collected(spark, d)
    return collection.recovery_audit(events.where("run = 'r1'"), items, events)


@query(f"""WITH {_RUNS} SELECT source, path, 'v1' AS revision FROM e WHERE k % 3 = 0 AND k % 2 = 1""")
def plan_extension(spark, d):
    """Candidates that no agent owns yet; who gets them is left out, as ties make that no matter of SQL."""
    e, _, _ = _collected(spark, d)
    plan = e.where("k % 2 = 0").select("source", "path", (F.col("k") % 3).cast("int").alias("agent"))
    candidates = e.where("k % 3 = 0").select("source", "path", F.lit("v1").alias("revision"))
    revisions = e.select("source", F.lit("v1").alias("revision")).distinct()
    return collection.extended_plan(plan, candidates.unionByName(candidates.where("length(path) = 2")), revisions, 200, 3).select("source", "path", "revision")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus")
def records_per_file(spark, d):
    folder = shared(spark, "files")
    table(spark, d, "orders").write.partitionBy("o_orderstatus").parquet(folder)
    counts = validation.file_counts(spark.read.parquet(folder))
    return counts.groupBy(F.regexp_extract("file", "o_orderstatus=([A-Z])", 1).alias("status")).agg(F.sum("n").alias("n"))


@query("""SELECT o_orderkey, sha256(CASE WHEN o_orderstatus = 'F' THEN '-' ELSE sha256(o_orderstatus) END || '|' || sha256(CAST(c_nationkey AS VARCHAR)) || '|' || 'v1') AS fingerprint FROM orders JOIN customer ON c_custkey = o_custkey""")
def input_fingerprints(spark, d):
    """Hashes of hashes: a customer's part is hashed once for each customer, not for each order."""
    own = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") != "F", F.sha2("o_orderstatus", 256)).alias("a"))
    shared_part = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.sha2(F.col("c_nationkey").cast("string"), 256).alias("b"))
    return own.join(shared_part, "o_custkey").select("o_orderkey", identity.combined_fingerprint(F.col("a"), F.col("b"), F.lit("v1")).alias("fingerprint"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_name ELSE 'old' END AS title, p_partkey % 3 > 0 AS reextracted, CASE WHEN p_partkey % 4 = 0 THEN 7.0 ELSE CAST(p_size AS DOUBLE) END AS total, CASE WHEN p_partkey % 2 = 0 THEN 75.0 END::DOUBLE AS cook FROM part""")
def reextracted_records(spark, d):
    """Records read again from their bodies: a whole second reading wins, and labelled lines fill times that are missing, character references and all."""
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    times = F.struct(*(F.lit(None).cast("double").alias(c) if c != "total_minutes" else F.when(k % 4 == 0, 7.0).alias(c) for c in publish.TIME_LABELS))
    record = F.struct(F.lit("old").alias("title"), times.alias("times"))
    parsed = F.struct(F.col("p_name").alias("title"), F.when(k % 3 > 0, F.array("p_type")).otherwise(F.array().cast("array<string>")).alias("ingredients"), F.array("p_brand").alias("instructions"))
    body = F.concat(F.lit("# Title\nTotal&#32;time:&nbsp;"), n, F.lit("&#160;mins&#10;"), F.when(k % 2 == 0, "<b>Cooking time</b>\n\n1 hour&nbsp;15&#x20;minutes\n").otherwise("nothing\n"))
    rows = table(spark, d, "part").withColumns({"r": record, "p": parsed, "body": body})
    out = rows.select("p_partkey", publish.reextracted(F.col("r"), F.col("p"), ["title"], F.col("body")).alias("x"))
    return out.select("p_partkey", "x.title", "x.reextracted", F.col("x.times.total_minutes").alias("total"), F.col("x.times.cook_minutes").alias("cook"))


@query("""SELECT p_partkey, CAST(i AS INTEGER) AS instruction_index, m::DOUBLE AS minimum_minutes, t AS source_duration FROM part, LATERAL (SELECT * FROM (VALUES (0, p_size * 60.0, p_size || ' hours'), (0, 5.0, '5-10 min'), (2, p_size * 1440.0, p_size || ' days')) AS v(i, m, t)) AS w(i, m, t)""")
def timing_evidence(spark, d):
    n = F.col("p_size").cast("string")
    steps = F.array(F.concat(F.lit("Simmer for "), n, F.lit(" hours, then bake 5-10 min.")), F.concat(F.lit("Leftovers keep for "), n, F.lit(" days; cook again.")), F.concat(F.lit("Marinate "), n, F.lit(" days")), F.lit("Wait 9 hours."))
    return table(spark, d, "part").select("p_partkey", F.explode(measure.timing_evidence(steps)).alias("x")).select("p_partkey", "x.*")


@query("""SELECT p_partkey, round(CASE WHEN p_size % 4 = 0 THEN 0.0 WHEN p_size % 4 = 1 THEN 1.0 ELSE 0.5 END, 6)::DOUBLE AS unresolved,
array_to_string(list_filter([CASE WHEN p_size % 5 = 0 THEN 'ingredient frequency/category aggregate, not a recipe ingredient list' END, CASE WHEN p_size % 3 = 0 THEN 'no parsed instructions' END, CASE WHEN p_size % 4 <= 1 THEN 'too few meaningful parsed ingredients' END], lambda x: x IS NOT NULL), '|') AS issues FROM part""")
def dish_faults(spark, d):
    """Shares of unresolved names, and frequency tables that pass for ingredient lists."""
    k = F.col("p_size")
    names = F.when(k % 4 == 0, F.array(F.lit("rice"), F.lit("rice"))).when(k % 4 == 1, F.array("p_name", F.lit(""), F.lit(None).cast("string"))).otherwise(F.array(F.lit("rice"), F.col("p_name"), F.lit("rice")))
    line = F.struct(F.when(k % 5 == 0, "Pasta _12_").otherwise("12 g pasta").alias("original_text"), F.lit(None).cast("double").alias("quantity"))
    issues = signals.dish_issues(names, F.array(F.lit("rice")), F.array_repeat(line, 20), F.when(k % 3 > 0, F.array(F.lit("Mix."))), 2)
    return table(spark, d, "part").select("p_partkey", issues.alias("x")).select("p_partkey", "x.unresolved", F.array_join("x.issues", "|").alias("issues"))
