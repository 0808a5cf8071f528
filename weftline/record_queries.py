"""More registered queries of the engine's own operators, with their SQL: items, eligibility, publishing, search, plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import identity, ingredients, measure
from .functions import text as tx
from .operators import collection, evidence, meals, publish, search, tables
from .operators.storage import shared
from .queries import ORACLE_SQL, QUERIES, query, table
from .sources import documents, prose, sitemap, web
from .streaming import ingest

_VOCABULARY = {"ring": ["rings"], "widget": ["widgets"], "bolt": [], "gear": ["gears", "cog wheel"]}
_LINE_SQL = """WITH p AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS q, p_partkey % 6 AS k, split_part(p_name, ' ', 2) AS noun FROM part),
v AS (SELECT *, CASE WHEN noun IN ('ring', 'widget', 'bolt', 'gear') THEN noun END AS known FROM p)"""


@query(_LINE_SQL + """ SELECT p_partkey, CASE k WHEN 0 THEN 15.0 * q WHEN 1 THEN 5 * (q + 0.5) WHEN 2 THEN round(453.592 * q, 3) WHEN 3 THEN q WHEN 4 THEN q ELSE NULL END::DOUBLE AS quantity,
CASE k WHEN 0 THEN 'mL' WHEN 1 THEN 'mL' WHEN 2 THEN 'g' END AS unit, CASE WHEN k = 2 THEN noun || ' (minced)' WHEN known IS NULL AND k = 0 THEN 'finely chopped ' || noun WHEN known IS NULL AND k = 3 THEN noun || ', drained and rinsed' ELSE noun END AS canonical, k = 1 AS optional,
CASE WHEN k <> 2 AND known IS NOT NULL THEN 'explicit-alias' ELSE 'unresolved-name' END AS method, CASE WHEN k = 3 THEN round(453.592, 3) END::DOUBLE AS package_quantity, CASE WHEN k = 4 THEN 'cloves' END AS count_unit FROM v""")  # fmt: skip
def item_lines(spark, d):
    """Six forms of item lines made of part numbers and names; the SQL knows the values that went into them."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("string").alias("q"), (F.col("p_partkey") % 6).alias("k"), F.split("p_name", " ")[1].alias("noun"))
    line = F.when(F.col("k") == 0, F.concat("q", F.lit(" tbsp finely chopped "), "noun")).when(F.col("k") == 1, F.concat("q", F.lit("½ teaspoons "), "noun", F.lit(" (optional)")))
    line = line.when(F.col("k") == 2, F.concat("q", F.lit(" lb "), "noun", F.lit(" (minced)"))).when(F.col("k") == 3, F.concat("q", F.lit(" (1 lb) cans "), "noun", F.lit(", drained and rinsed")))
    line = line.when(F.col("k") == 4, F.concat("q", F.lit(" cloves of "), "noun", F.lit(", diced"))).otherwise(F.concat("noun", F.lit(", to taste")))
    out = ingredients.parse_items(p.withColumn("line", line), "line", _VOCABULARY, normalized=True)
    return out.select("p_partkey", "item.quantity", "item.unit", "item.canonical", "item.optional", "item.method", F.col("item.package.quantity").alias("package_quantity"), "item.count_unit")


@query(_LINE_SQL + " SELECT noun, max(known) AS canonical FROM (SELECT noun, known FROM v) GROUP BY noun HAVING max(known) IS NOT NULL UNION ALL SELECT noun, noun FROM v GROUP BY noun HAVING max(known) IS NULL")
def resolved_names(spark, d):
    names = table(spark, d, "part").select(F.split("p_name", " ")[1].alias("noun"))
    spellings = spark.createDataFrame(list(ingredients.vocabulary(_VOCABULARY).items()), "spelling string, canonical string")
    return ingredients.resolve_names(names, "noun", spellings, normalized=True)


_MEAL_SQL = """WITH o AS (SELECT l_orderkey, list(p_name ORDER BY l_linenumber) AS names, list_distinct(list(p_type)) AS types, bool_or(p_size >= 40) AS protein, bool_or(l_returnflag = 'R') AS vegetable, bool_or(p_type = 'PROMO') AS staple, count(*) AS n,
count(DISTINCT p_name) AS n_names, count(DISTINCT p_name) FILTER (p_name IN ('red ring', 'small ring', 'blue bolt')) AS rich, count(*) FILTER (p_type = 'ECONOMY') AS processed, coalesce(sum(l_quantity) FILTER (p_type = 'SMALL'), 0) AS fat FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey)"""


def _meals(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    item = F.struct("l_linenumber", F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.col("l_quantity").alias("quantity"), F.lit("g").alias("unit"), (F.col("l_linenumber") > 4).alias("optional"), F.concat("p_type", F.lit(" "), "p_name").alias("original_text"))
    return rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"), F.bool_or(F.col("p_size") >= 40).alias("protein"), F.bool_or(F.col("l_returnflag") == "R").alias("vegetable"), F.bool_or(F.col("p_type") == "PROMO").alias("staple"))


@query(_MEAL_SQL + """, t AS (SELECT *, CASE l_orderkey % 5 WHEN 0 THEN 'fruit pizza' WHEN 1 THEN 'beef stew' WHEN 2 THEN 'taco seasoning' WHEN 3 THEN 'dinner' ELSE 'green salad' END AS title FROM o),
m AS (SELECT *, CASE WHEN title = 'fruit pizza' THEN 'Dessert' WHEN title = 'taco seasoning' THEN 'Side dish' WHEN title = 'beef stew' THEN 'Soup/stew' WHEN title = 'green salad' THEN 'Salad' WHEN protein AND vegetable AND staple THEN 'Full meal' WHEN protein THEN 'Main dish' ELSE 'Side dish' END AS kind FROM t)
SELECT l_orderkey, kind, kind IN ('Full meal', 'Main dish', 'Soup/stew', 'Salad') AND protein AND n >= 3 AND l_orderkey % 11 <> 0 AS eligible FROM m""")  # fmt: skip
def eligibility(spark, d):
    """Roles, meal types and everyday eligibility of orders taken as records."""
    from .operators.classify import meal_type

    rows = _meals(spark, d)
    for k, title in enumerate(("fruit pizza", "beef stew", "taco seasoning", "dinner", "green salad")):
        rows = rows.withColumn("title", F.when(F.col("l_orderkey") % 5 == k, title).otherwise(F.col("title") if k else F.lit("")))
    names, categories = F.transform("items", lambda i: i["name"]), F.transform("items", lambda i: i["category"])
    role = meals.practical_role(F.lit("unknown"), F.col("title"), names, categories, r"(?i)\bcookies\b")
    kind = meal_type(role, F.col("title"), F.col("protein"), F.col("vegetable"), F.col("staple"), F.lit(False))
    issues = F.filter(F.array(F.when(F.size("items") < 3, "too few meaningful parsed ingredients"), F.lit("explicit instruction duration exceeds total")), lambda x: x.isNotNull())
    steps = F.when(F.col("l_orderkey") % 11 == 0, F.array(F.lit("Put it into the dishwasher."))).otherwise(F.array(F.lit("Cook.")))
    return rows.withColumn("kind", kind).select("l_orderkey", "kind", meals.everyday_eligible(F.col("kind"), F.col("protein"), meals.structural_issues(issues), F.col("title"), steps).alias("eligible"))


@query(_MEAL_SQL + " SELECT l_orderkey, round(rich / n_names, 6) AS rich, round(processed / n, 6) AS processed FROM o")
def item_shares(spark, d):
    rows = _meals(spark, d)
    mixed = F.transform("items", lambda i: F.struct(i["name"], F.when(i["category"] == "ECONOMY", "condensed x").otherwise("plain").alias("original_text")))
    rich = meals.named_fraction(F.transform("items", lambda i: i["name"]), ["red ring", "small ring", "blue bolt"])
    return rows.select("l_orderkey", F.round(rich, 6).alias("rich"), F.round(meals.processed_fraction(mixed, []), 6).alias("processed"))


@query("""SELECT l_orderkey, CAST(coalesce(sum(l_quantity * CASE WHEN l_linenumber % 4 = 0 THEN 1000 ELSE 1 END) FILTER (l_linenumber % 2 = 0), 0) AS DOUBLE) AS fat,
coalesce(array_to_string(list_sort(list_distinct(list('item' || l_partkey % 7) FILTER (l_partkey % 7 < 3 AND l_linenumber <= 4 AND l_quantity >= 30))), ','), '') AS mains FROM lineitem GROUP BY l_orderkey""")  # fmt: skip
def fat_and_mains(spark, d):
    rows = table(spark, d, "lineitem").withColumn("name", F.concat(F.lit("item"), (F.col("l_partkey") % 7).cast("string")))
    fat = F.struct(F.when(F.col("l_linenumber") % 2 == 0, "butter").otherwise("flour").alias("name"), F.col("l_quantity").alias("quantity"), F.when(F.col("l_linenumber") % 4 == 0, "L").otherwise("mL").alias("unit"))
    main = F.struct("name", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity") / 1000).otherwise(F.col("l_quantity")).alias("quantity"), F.when(F.col("l_linenumber") % 2 == 0, "kg").otherwise("g").alias("unit"), (F.col("l_linenumber") > 4).alias("optional"))
    grouped = rows.groupBy("l_orderkey").agg(F.collect_list(fat).alias("fats"), F.collect_list(main).alias("mains"))
    unknown = F.array(*(F.lit(f"item{k}") for k in range(3)))
    return grouped.select("l_orderkey", meals.added_fat(F.col("fats")).alias("fat"), F.array_join(meals.unknown_mains(F.col("mains"), unknown, 30 - 1e-9), ",").alias("mains"))


@query("""WITH s AS (SELECT o_orderkey, o_totalprice / 5000 AS score, o_orderkey % 40 AS active, o_orderkey % 60 AS total, (o_orderkey % 10) / 10.0 AS coverage FROM orders)
SELECT o_orderkey, CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 80 THEN 'Strong' WHEN score >= 70 THEN 'Good' WHEN score >= 60 THEN 'Usable' ELSE 'Low priority' END AS label,
array_to_string(list_filter([CASE WHEN coverage >= 0.85 THEN 'Ingredients generally sold at the shop' WHEN coverage >= 0.7 THEN 'Most ingredients fit the shop' ELSE 'Some ingredient choices may need checking' END,
CASE WHEN active > 0 AND active <= 15 THEN 'At most 15 minutes of active work' WHEN total <= 30 THEN 'Ready within 30 minutes' WHEN active = 0 THEN 'Active time not listed; effort estimated from recipe steps' END,
CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'Protein and vegetables' WHEN o_orderkey % 2 = 0 THEN 'Includes a protein source' END, CASE WHEN o_orderkey % 7 = 0 THEN 'Check the original recipe before cooking' END], lambda x: x IS NOT NULL), '|') AS reasons FROM s""")  # fmt: skip
def score_explained(spark, d):
    k = F.col("o_orderkey")
    active = F.when(k % 40 > 0, k % 40)
    why = meals.explanation(F.lit(False), F.lit(False), (k % 10) / 10.0, active, k % 60, k % 2 == 0, k % 3 == 0, F.lit(False), F.lit(False), F.lit(False), F.lit(False), k % 7 == 0)
    return table(spark, d, "orders").select("o_orderkey", meals.score_label(F.col("o_totalprice") / 5000).alias("label"), F.array_join(why, "|").alias("reasons"))


@query("SELECT l_orderkey, l_partkey % 5 AS name, bool_and(l_linenumber > 3) AS optional FROM lineitem GROUP BY 1, 2")
def distinct_items(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 5).alias("name"), F.when(F.col("l_linenumber") != 3, F.col("l_linenumber") > 3).alias("optional"))
    return meals.distinct_items(rows, "l_orderkey", "name", "optional")


@query("SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS flags, array_to_string(list_sort(list(DISTINCT l_suppkey % 9)), ',') AS suppliers FROM lineitem GROUP BY l_orderkey")
def distinct_lists(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("flags"), (F.col("l_suppkey") % 9).alias("suppliers"))
    out = meals.distinct_lists(rows, "l_orderkey", ["flags", "suppliers"])
    return out.select("l_orderkey", F.array_join("flags", ",").alias("flags"), F.array_join(F.transform("suppliers", lambda x: x.cast("string")), ",").alias("suppliers"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def cohort_join(spark, d):
    some = table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, d, "orders")
    return meals.cohort(orders, "o_custkey", some, orders.where("o_orderstatus = 'F'")).select("o_orderkey")


@query("""WITH s AS (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS a, CAST(NULL AS VARCHAR) AS b FROM orders UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 AND o_orderstatus <> 'F' THEN NULL ELSE nullif(o_orderstatus, 'F') END, CASE WHEN o_orderkey % 4 = 0 AND o_orderstatus <> 'F' THEN o_orderstatus END FROM orders)
SELECT o_orderkey, count(DISTINCT coalesce(a, '~') || '/' || coalesce(b, '~')) AS versions FROM s GROUP BY o_orderkey HAVING count(DISTINCT coalesce(a, '~') || '/' || coalesce(b, '~')) > 1""")  # fmt: skip
def merge_shards_nulls(spark, d):
    """Shards that agree but for the column in which a value stands beside a null."""
    rows = table(spark, d, "orders").select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("a"), F.lit(None).cast("string").alias("b"))
    moved = (F.col("o_orderkey") % 4 == 0) & F.col("a").isNotNull()
    again = rows.select("o_orderkey", F.when(~moved, F.col("a")).alias("a"), F.when(moved, F.col("a")).alias("b"))
    return tables.merge_shards([rows, again], "o_orderkey")[1]


@query("""WITH g AS (SELECT o_custkey, o_orderstatus, min(o_orderkey) AS representative FROM orders GROUP BY ALL), r AS (SELECT o.*, representative FROM orders o JOIN g USING (o_custkey, o_orderstatus))
SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS DOUBLE) AS score, CASE WHEN o_orderkey % 3 > 0 THEN 'scored' ELSE 'unknown' END AS state, o_orderstatus = 'O' AS allowed, CASE WHEN o_orderstatus = 'O' THEN 2 ELSE 0 END AS n_steps,
CASE WHEN o_custkey % 2 = 0 THEN c_name ELSE o_orderpriority END AS original_title, CASE WHEN o_custkey % 5 < 3 AND o_orderkey % 2 = 0 THEN 'https://h.example/' || o_custkey % 5 || '/blob/r1/LICENSE%20' || o_custkey % 5 || '.md' END AS license_url
FROM r LEFT JOIN customer ON c_custkey = o_custkey AND o_custkey % 2 = 0 WHERE o_orderkey = representative""")  # fmt: skip
def published_records(spark, d):
    """Orders as records: representatives of duplicates, joined with matches, captured titles and source licenses."""
    orders = table(spark, d, "orders")
    records = orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.concat(F.lit("https://h.example/"), (F.col("o_custkey") % 5).cast("string"), F.lit("/")).alias("source"),
        F.when(F.col("o_orderkey") % 2 == 0, "r1").alias("revision"), F.col("o_custkey").alias("raw_id"), F.when(F.col("o_orderstatus") == "O", True).alias("allowed"), F.array(F.lit("a"), F.lit("b")).alias("steps"),
    )
    first = orders.groupBy("o_custkey", "o_orderstatus").agg(F.min("o_orderkey").alias("representative"))
    members = orders.join(first, ["o_custkey", "o_orderstatus"]).select(F.col("o_orderkey").alias("id"), "representative")
    matches = orders.where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"), F.lit("scored").alias("state"))
    captured = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("raw_id"), F.col("c_name").alias("original_title"))
    sources = spark.range(3).select(F.concat(F.lit("https://h.example/"), F.col("id").cast("string"), F.lit("/")).alias("source"), F.concat(F.lit("LICENSE "), F.col("id").cast("string"), F.lit(".md")).alias("license_path"))
    rows, _, _ = publish.published(records, matches, members, captured, sources)
    return rows.select("id", "score", "state", "allowed", F.size("steps").alias("n_steps"), "original_title", "license_url")


@query("""WITH g AS (SELECT o_custkey, min(o_orderkey) AS representative FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1)
SELECT o_orderkey AS id, coalesce(representative, o_orderkey) AS representative, coalesce(representative, o_orderkey) = o_orderkey AS is_representative,
CASE WHEN coalesce(representative, o_orderkey) <> o_orderkey AND o_orderstatus = 'O' THEN 'duplicate-variant' WHEN o_orderstatus = 'O' THEN 'recommended' ELSE 'not-recommended' END AS status,
CASE WHEN coalesce(representative, o_orderkey) <> o_orderkey AND o_orderstatus = 'O' THEN 2 ELSE 1 END AS n_reasons FROM orders LEFT JOIN g USING (o_custkey)""")  # fmt: skip
def duplicate_variants(spark, d):
    orders = table(spark, d, "orders")
    rows = orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "recommended").otherwise("not-recommended").alias("status"), F.array(F.lit("why")).alias("reasons"))
    groups = orders.where("o_custkey % 2 = 0").groupBy("o_custkey").agg(F.min("o_orderkey").alias("representative"))
    members = orders.join(groups, "o_custkey").select(F.col("o_orderkey").alias("id"), "representative")
    return publish.duplicate_variants(rows, members).select("id", "representative", "is_representative", "status", F.size("reasons").alias("n_reasons"))


_FOUND_SQL = """WITH r AS (SELECT p_partkey AS id, p_name AS title, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_partkey AS position, CASE WHEN p_size % 4 > 0 THEN p_size END AS minutes FROM part),
f AS (SELECT *, (a = 'red')::INT + (b IN ('ring', 'widget'))::INT AS n_items FROM r WHERE a = 'red' AND b IN ('ring', 'widget')),
q AS (SELECT *, CASE WHEN title = 'red ring' THEN 0 ELSE 2 END AS priority FROM f)"""


def _found(spark, d):
    """Parts as records whose two words are items; "round thing" is a curated spelling of ring and widget."""
    part = table(spark, d, "part")
    word = F.split("p_name", " ")
    curated = lambda w: F.when(w.isin("ring", "widget"), F.array(F.lit("Round-Thing"))).otherwise(F.array().cast("array<string>"))
    items = F.array(*(F.struct(w.alias("canonical"), F.concat(F.array(w), curated(w)).alias("terms"), curated(w).alias("aliases")) for w in (word[0], word[1])))
    rows = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_partkey").alias("position"), F.when(F.col("p_size") % 4 > 0, F.col("p_size")).alias("minutes"), items.alias("items"))
    terms, variants = search.prepare(rows, F.col("items"), normalized=True)
    return search.rank(rows, search.query_parts("red round thing", terms, variants), [F.col("title")], F.col("items"), F.col("title"))


@query(_FOUND_SQL.replace("CASE WHEN title = 'red ring' THEN 0 ELSE 2 END", "2") + " SELECT id, CAST(n_items AS INTEGER) AS n_items, priority, row_number() OVER (ORDER BY priority, n_items DESC, position, title, id) AS place FROM q")
def search_order(spark, d):
    from pyspark.sql import Window

    return _found(spark, d).select("id", "n_items", "priority", F.row_number().over(Window.orderBy(*search.order("default", True))).cast("bigint").alias("place"))


@query(_FOUND_SQL + " SELECT id, minutes, row_number() OVER (ORDER BY minutes NULLS LAST, title, id) AS by_time, row_number() OVER (ORDER BY title, id) AS by_name FROM q")
def other_orders(spark, d):
    from pyspark.sql import Window

    place = lambda kind: F.row_number().over(Window.orderBy(*search.order(kind, True))).cast("bigint")
    return _found(spark, d).select("id", "minutes", place("time").alias("by_time"), place("name").alias("by_name"))


@query("""SELECT DISTINCT * FROM (SELECT split_part(p_name, ' ', 1) AS canonical, split_part(p_name, ' ', 1) AS term FROM part UNION ALL SELECT split_part(p_name, ' ', 2), split_part(p_name, ' ', 2) FROM part
UNION ALL SELECT split_part(p_name, ' ', 2), 'round thing' FROM part WHERE split_part(p_name, ' ', 2) IN ('ring', 'widget'))""")  # fmt: skip
def search_terms(spark, d):
    word = F.split("p_name", " ")
    items = F.array(*(F.struct(w.alias("canonical"), F.when(w.isin("ring", "widget"), F.array(F.lit("Round, THING!"))).alias("terms"), F.lit(None).cast("array<string>").alias("aliases")) for w in (word[0], word[1])))
    return search.prepare(table(spark, d, "part").select(items.alias("items")), F.col("items"), normalized=True)[0]


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size + 60.0 WHEN p_partkey % 3 = 1 THEN nullif(p_size, 0) END::DOUBLE AS total_minutes, CASE WHEN p_partkey % 2 = 0 THEN 5.0 END::DOUBLE AS active_minutes, NULL::DOUBLE AS cook_minutes FROM part""")
def labelled_times(spark, d):
    n = F.col("p_size").cast("string")
    total = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("<p>**Total time:** 1 hr "), n, F.lit(" mins</p>"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("## Ready in\n\n"), n, F.lit(" minutes."))).otherwise(F.lit("Total time: soon"))
    text = F.concat_ws("\n", F.lit("Cooking: a while"), total, F.when(F.col("p_partkey") % 2 == 0, F.lit("Hands-on time 5m")), F.lit("end"))
    return table(spark, d, "part").select("p_partkey", publish.labelled_times(text).alias("t")).select("p_partkey", "t.total_minutes", "t.active_minutes", "t.cook_minutes")


@query("SELECT p_partkey, CAST(p_partkey % 4 AS INTEGER) AS position, CASE WHEN p_size > 25 THEN p_size END AS minutes FROM part WHERE p_partkey % 4 < 2")
def identity_filter(spark, d):
    """Items without a letter in their name are logged with their positions; times that aren't positive are dropped."""
    part = table(spark, d, "part")
    at = F.transform(F.sequence(F.lit(0), F.lit(1)), lambda k: F.struct(F.when(F.col("p_partkey") % 4 == k, F.lit("12 ½")).otherwise(F.col("p_name")).alias("name")))
    _, gone = publish.meaningful_items(part, "p_partkey", at, "name")
    return gone.join(part.select("p_partkey", publish.positive(F.col("p_size") - 25).alias("over")), "p_partkey").select("p_partkey", "position", (F.col("over") + 25).alias("minutes"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderstatus = 'O' THEN 'verified_available' WHEN o_orderkey % 2 = 0 AND o_orderstatus = 'F' THEN 'unavailable' WHEN o_orderkey % 2 = 1 AND o_orderstatus = 'O' THEN 'likely_available' ELSE 'unknown' END AS state FROM orders")
def observation_state(spark, d):
    seen = F.when(F.col("o_orderstatus") == "O", True).when(F.col("o_orderstatus") == "F", False)
    return table(spark, d, "orders").select("o_orderkey", evidence.observation_state(seen, (F.col("o_orderkey") % 2).cast("string"), F.lit("specific_store"), F.lit("0")).alias("state"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' OR o_orderkey % 5 = 0 THEN 'yes' WHEN o_orderkey % 3 = 0 THEN 'probably' ELSE 'unknown' END AS fits FROM orders")
def compatibility(spark, d):
    state = F.when(F.col("o_orderstatus") == "O", "likely_available").otherwise("unknown")
    item = F.concat(F.lit("i"), (F.col("o_orderkey") % 3).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", evidence.compatibility(state, F.when(F.col("o_orderkey") % 5 == 0, True), item, ["i0"]).alias("fits"))


@query("SELECT p_partkey, trim(lower(p_name)) || '; ' || lower(p_brand) AS name FROM part")
def clean_names(spark, d):
    messy = F.concat(F.lit(" *"), F.upper("p_name"), F.lit("_; [  "), "p_brand", F.lit("] .,"))
    return table(spark, d, "part").select("p_partkey", tx.clean_name(messy).alias("name"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'jar (check source capacity)' WHEN 1 THEN '2 (' || p_size || ' oz) can ' || p_name ELSE p_size || ' tbsp sugar' END AS line FROM part")
def measure_layouts(spark, d):
    n = F.col("p_size").cast("string")
    line = F.when(F.col("p_partkey") % 3 == 0, F.concat(n, F.lit("-oz. jar"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("2 - "), n, F.lit("oz can "), "p_name")).otherwise(F.concat(n, F.lit(" tbspsugar")))
    return table(spark, d, "part").select("p_partkey", measure.measurement_layout(line).alias("line"))


@query("SELECT n, count(*) AS groups FROM (SELECT count(*) AS n FROM part GROUP BY p_name, p_size % 4, p_brand) GROUP BY n")
def fingerprint_groups(spark, d):
    """Sizes of groups of equal content: items in any order, steps in order."""
    item = lambda x: F.struct(x.alias("n"))
    a, b = F.col("p_brand"), (F.col("p_size") % 4).cast("string")
    items = F.when(F.col("p_partkey") % 2 == 0, F.array(item(a), item(b))).otherwise(F.array(item(b), item(a)))
    mark = identity.content_fingerprint(F.col("p_name"), F.lit(None).cast("string"), items, F.array(F.lit("Mix."), F.lit("Serve.")))
    return table(spark, d, "part").select(mark.alias("f")).groupBy("f").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("groups"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value ELSE value + 1 END AS value FROM events")
def incremental_upsert(spark, d):
    """Two deliveries of events through a stream that ends when all is read; what came first stays, a replay changes nothing."""
    folder = shared(spark, "upsert")
    events, schema = table(spark, d, "events").select("event_id", "value"), "event_id bigint, value double"
    for mode, rows in (("a", events.where("event_id % 2 = 0")), ("b", events.withColumn("value", F.col("value") + 1)), ("b", None)):
        if rows is not None:
            rows.write.parquet(f"{folder}/in/{mode}")
        ingest.ingest(spark, f"{folder}/in/*", schema, f"{folder}/out", f"{folder}/mark", "event_id")
    return ingest.ingested(spark, f"{folder}/out", schema)


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_orderkey, NULL, l_linenumber FROM lineitem WHERE l_returnflag = 'R'")
def union_sorted(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    out = tables.union_sorted([rows.where("l_returnflag = 'A'").drop("l_returnflag"), rows.where("l_returnflag = 'R'").drop("l_returnflag", "l_partkey")], F.col("l_orderkey"), F.col("l_linenumber"))
    return out.select("l_orderkey", "l_partkey", "l_linenumber")


@query("SELECT 'https://s.example/p/thing-' || page_id % 7 || '/id_' || page_id AS source_url, 'thing-' || page_id % 7 AS slug, CAST(page_id AS VARCHAR) AS product_id FROM pages WHERE page_id % 4 > 0")
def sitemap_urls(spark, d):
    folder, k = shared(spark, "sitemap"), F.col("page_id").cast("string")
    loc = F.concat(F.lit("https://s.example/p/thing-"), (F.col("page_id") % 7).cast("string"), F.when(F.col("page_id") % 4 > 0, F.concat(F.lit("/id_"), k)).otherwise(F.lit("/")))
    urls = table(spark, d, "pages").select((F.col("page_id") % 8).alias("file"), F.concat(F.lit("<url><loc> "), loc, F.lit(" </loc><lastmod>2024-01-01</lastmod></url>")).alias("x"))
    whole = urls.groupBy("file").agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list("x"), "\n"), F.lit("</urlset>")).alias("value"))
    whole.repartition("file").write.partitionBy("file").text(folder)
    return sitemap.read_sitemap(spark, folder)


_LAYOUTS = {"inter/": prose.interleaved, "lead/": prose.leading_list}


@query("""SELECT p_partkey, pos AS file_position, CASE WHEN k = 0 THEN ['A ', 'B '][pos + 1] || p_name ELSE p_name END AS title, CASE k WHEN 0 THEN [p_brand, p_type][pos + 1] WHEN 3 THEN '1 g ' || p_brand || '|2 g ' || p_type || '|3 g salt' ELSE p_brand || '|' || p_type END AS items,
CASE k WHEN 0 THEN 'Mix.' WHEN 1 THEN 'Chop:|Fry:' WHEN 2 THEN 'Mix.|Bake.' WHEN 3 THEN 'Mix it.' ELSE 'Mix.|Serve.' END AS steps
FROM (SELECT *, CAST(p_partkey % 5 AS INTEGER) AS k, unnest(CASE WHEN p_partkey % 5 = 0 THEN [0, 1] ELSE [0] END) AS pos FROM part)""")  # fmt: skip
def parse_layouts(spark, d):
    """Several cards in a file, interleaved and leading lists, scans, export cards."""
    c = {k: F.col(k).cast("string") for k in ("p_name", "p_brand", "p_type", "p_partkey")}
    say = lambda *parts: F.concat(*(c[x] if x in c else F.lit(x) for x in parts))
    bodies = [
        ("", ".md", say("# A ", "p_name", "\n## Ingredients\n- ", "p_brand", "\n## Method\nMix.\n# B ", "p_name", "\n## Ingredients\n- ", "p_type", "\n## Method\nMix.\n")),
        ("inter/", ".md", say("# ", "p_name", "\nChop:\n- ", "p_brand", "\nFry:\n- ", "p_type", "\n")),
        ("lead/", ".md", say("p_name", "\n===\n- ", "p_brand", "\n- ", "p_type", "\n\nMix.\n1. Bake.\n# Notes\nz\n")),
        ("", ".json", say('{"analyzeResult": {"content": "', "p_name", "\\nIngredients\\n1 g ", "p_brand", "\\n2 g ", "p_type", '\\n3 g salt\\nMethod\\nMix it."}}')),
        ("", ".html", say('<div class="recipe-details"><h2 itemprop="name">', "p_name", '</h2><p class="recipeIngredient">', "p_brand", '</p><p class="recipeIngredient">', "p_type", '</p><p class="instruction">Mix.</p><p class="instruction">Serve.</p></div>')),
    ]
    kind, text, path = F.col("p_partkey") % 5, F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (folder, end, body) in enumerate(bodies):
        text, path = F.when(kind == k, body).otherwise(text), F.when(kind == k, say(folder, "p_partkey", end)).otherwise(path)
    captured = table(spark, d, "part").select("p_partkey", path.alias("path"), text.alias("content"))
    rows = documents.records(documents.parse_documents(captured, F.col("path"), F.col("content"), _LAYOUTS), ["p_partkey"])
    return rows.select("p_partkey", "file_position", "title", F.array_join("ingredients", "|").alias("items"), F.array_join("instructions", "|").alias("steps"))


@query("""WITH e AS (SELECT p_name, CASE p_size % 4 WHEN 0 THEN 'verified_available' WHEN 1 THEN 'likely_available' WHEN 2 THEN 'unavailable' ELSE 'unknown' END AS state FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey) AS r FROM part WHERE p_name LIKE '%e%') WHERE r = 1)
SELECT l_orderkey, count(*) FILTER (state = 'verified_available') AS verified, count(*) FILTER (state = 'likely_available') AS likely, count(*) FILTER (coalesce(state, 'unknown') = 'unknown') AS unknown, count(*) FILTER (state = 'unavailable') AS unavailable
FROM lineitem JOIN part ON p_partkey = l_partkey LEFT JOIN e USING (p_name) GROUP BY l_orderkey""")  # fmt: skip
def state_counts(spark, d):
    """Items of orders with their name's best inventory entry, counted by its state."""
    part = table(spark, d, "part")
    kind = F.col("p_size") % 4
    entries = part.where("p_name like '%e%'").select("p_name", "p_partkey", "p_retailprice", F.when(kind == 0, "verified_available").when(kind == 1, "likely_available").when(kind == 2, "unavailable").otherwise("unknown").alias("state"))
    items = table(spark, d, "lineitem").join(part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey").select("l_orderkey", "p_name")
    return evidence.state_counts(evidence.with_inventory(items, entries, "p_name", F.col("p_retailprice"), F.col("p_partkey")), ["l_orderkey"], "state")


@query("""SELECT rule, count(DISTINCT p_partkey) AS n_products, min(p_partkey) AS first_id, max(p_size) AS last_observed FROM (SELECT *, lower(p_brand) AS slug FROM part)
JOIN (VALUES ('brand#', 'any'), ('brand#1', 'one'), ('brand#2', 'two')) AS r(prefix, rule) ON starts_with(slug, prefix) AND regexp_matches(substr(slug, length(prefix) + 1, 1), '[0-9]') GROUP BY rule""")  # fmt: skip
def evidence_rollup(spark, d):
    rules = spark.createDataFrame([("brand#", "any"), ("brand#1", "one"), ("brand#2", "two")], "prefix string, rule string")
    pairs = evidence.prefix_rules(table(spark, d, "part").select("p_partkey", "p_size", F.lower("p_brand").alias("slug")), rules)
    return evidence.matched_rollup(pairs, "rule", "p_partkey", "p_size").select("rule", "n_products", F.get("product_ids", F.lit(0)).alias("first_id"), "last_observed")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Add ' || p_size * 15 || ' mL oil.' WHEN 1 THEN 'A 15 mL measure of ' || p_name ELSE p_name END AS text, 'https://x.example/2 tbsp/' || p_partkey AS url FROM part")
def unit_rewrite(spark, d):
    """Strings of any nesting in metric units; URLs stay as they are."""
    n = F.col("p_size").cast("string")
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Add "), n, F.lit(" tbsp oil."))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("A tablespoon of "), "p_name")).otherwise(F.col("p_name"))
    rows = table(spark, d, "part").select("p_partkey", F.array(F.struct(text.alias("text"), F.concat(F.lit("https://x.example/2 tbsp/"), F.col("p_partkey").cast("string")).alias("url"))).alias("deep"))
    out = publish.publish(rows, ["p_partkey", "deep"], rewrite=publish.without_units, skip=("url",))
    return out.select("p_partkey", F.col("deep")[0]["text"].alias("text"), F.col("deep")[0]["url"].alias("url"))


@query("SELECT o_orderkey, coalesce(c_name, 'customer ' || o_custkey) AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_nationkey < 12")
def named_records(spark, d):
    names = table(spark, d, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name"))
    return tables.named(table(spark, d, "orders").select("o_orderkey", "o_custkey"), names, "o_custkey", "name", F.concat(F.lit("customer "), F.col("o_custkey").cast("string"))).select("o_orderkey", "name")


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' – ' || p_brand || '!'), '[^a-z0-9]+', ' ', 'g')) AS text FROM part")
def search_texts(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.search_text(F.concat(F.upper("p_name"), F.lit(" – "), "p_brand", F.lit("!"))).alias("text"))


@query("""SELECT p_partkey, CASE WHEN p_name LIKE '%e%' THEN 'explicit' WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'source-inference' END AS kind, CASE WHEN p_name LIKE '%e%' THEN p_name WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'known brand' END AS value FROM part""")
def group_basis(spark, d):
    from .operators.scope import group_basis as basis

    source = F.concat("p_brand", F.lit("/"))
    return table(spark, d, "part").select("p_partkey", basis(F.col("p_name"), ["e"], source, {"Brand#1/": "known brand", "Brand#2/": "known brand"}).alias("b")).select("p_partkey", "b.kind", "b.value")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Italian' WHEN 1 THEN 'Portuguese,Spanish' WHEN 2 THEN 'Italian,Portuguese,Spanish' ELSE 'Unknown' END AS labels FROM part""")
def cuisine_labels(spark, d):
    said = F.element_at(F.array(*map(F.lit, ("ITALIAN", " iberian ", "iberian, italian,x", "other"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.array_join(tx.labels(said, {"italian": "Italian", "iberian": "Spanish,Portuguese"}), ",").alias("labels"))


@query("""SELECT p_partkey, CASE WHEN p_name LIKE 'red%' AND p_name NOT LIKE '%ring' THEN 'side' WHEN p_partkey % 5 = 0 THEN 'drink' WHEN p_size > 20 AND p_partkey % 2 = 0 THEN 'meal_candidate' ELSE 'unknown' END AS role FROM part""")
def dish_roles(spark, d):
    from .operators.classify import dish_role

    tags = F.when(F.col("p_partkey") % 5 == 0, F.array(F.lit("cold"), F.lit("Drink")))
    return table(spark, d, "part").select("p_partkey", dish_role(F.col("p_name"), tags, [("side", r"^red\b")], r"ring$", F.col("p_size") > 20, F.col("p_partkey") % 2 == 0).alias("role"))


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 2 = 0 THEN 'oven' END, CASE WHEN p_partkey % 3 = 0 THEN 'stovetop' END, CASE WHEN p_partkey % 5 = 0 THEN 'one-pan' END, CASE WHEN p_partkey % 7 = 0 THEN 'microwave' END], lambda x: x IS NOT NULL), ',') AS methods FROM part""")
def method_tags(spark, d):
    from .operators import signals

    k = F.col("p_partkey")
    none = F.array().cast("array<string>")
    some = lambda n, text: F.when(k % n == 0, F.array(F.lit(text))).otherwise(none)
    title = F.when(k % 5 == 0, F.concat(F.lit("One-Pot "), "p_name")).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", F.array_join(signals.method_tags(title, some(2, "Oven"), some(3, "a skillet"), some(7, "Use the microwave.")), ",").alias("methods"))


@query("SELECT o_orderkey, representative FROM (SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderstatus) AS representative, count(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS n FROM orders) WHERE n > 1")
def duplicate_members(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.concat_ws("/", "o_custkey", "o_orderstatus").alias("mark"))
    return tables.duplicate_members(orders, "mark", "o_orderkey").select("o_orderkey", "representative")


def recorded_answer(url: str) -> tuple[int, str]:
    """Answers of five hosts: one with rules, one without, one that refuses access, one that is broken, one with no rules file."""
    host, _, path = url.removeprefix("https://").partition("/")
    if path == "robots.txt":
        return {"h0.example": (200, "User-agent: *\nDisallow: /p/1\n"), "h2.example": (403, ""), "h3.example": (503, "")}.get(host, (404, ""))
    k = int(path.removeprefix("p/"))
    return (500, "") if k % 7 == 0 else (302, "") if k % 11 == 0 else (200, f"<p itemprop=\"name\">page &amp; {k}</p>")


@query("""WITH p AS (SELECT page_id AS k, page_id % 5 AS h FROM pages)
SELECT k AS page_id, CASE WHEN k % 10 = 4 THEN 'cached' WHEN h = 2 THEN 'blocked' WHEN h = 3 THEN 'failed' WHEN h = 0 AND starts_with(CAST(k AS VARCHAR), '1') THEN 'blocked' WHEN k % 7 = 0 THEN 'failed' WHEN k % 11 = 0 THEN 'blocked' ELSE 'fetched' END AS outcome,
CASE WHEN k % 10 = 4 THEN 'kept' WHEN h IN (2, 3) OR (h = 0 AND starts_with(CAST(k AS VARCHAR), '1')) OR k % 7 = 0 OR k % 11 = 0 THEN NULL ELSE 'page & ' || k END AS name,
k % 10 <> 4 AND (h = 3 OR (h <> 2 AND NOT (h = 0 AND starts_with(CAST(k AS VARCHAR), '1')) AND k % 7 = 0)) AS retryable FROM p""")  # fmt: skip
def replayed_fetch(spark, d):
    """Pages through a client of recorded answers, with robots' rules, refusals, redirects, errors and a cache."""
    k = F.col("page_id")
    urls = table(spark, d, "pages").select("page_id", F.concat(F.lit("https://h"), (k % 5).cast("string"), F.lit(".example/p/"), k.cast("string")).alias("url"))
    cache = urls.where("page_id % 10 = 4").select("url", F.lit("<p itemprop=\"name\">kept</p>").alias("body"))
    got = web.page_fields(web.fetch(urls, "url", recorded_answer, "weftline", cache), "body", {"name": 'itemprop="name">([^<]+)'})
    return urls.join(got, "url").select("page_id", "outcome", "name", "retryable")


@query("""WITH o AS (SELECT o_custkey % 50 AS source, o_orderkey AS url, o_custkey % 50 <> 7 AS complete, CASE WHEN o_custkey % 50 = 3 THEN 'blocked' WHEN o_orderkey % 97 = 0 THEN 'failed' WHEN o_orderkey % 89 = 0 AND o_custkey % 50 < 25 THEN NULL ELSE 'fetched' END AS outcome FROM orders),
s AS (SELECT source, count(*) AS discovered, count(*) FILTER (outcome = 'fetched') AS fetched, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'blocked') AS blocked, count(*) FILTER (outcome IS NULL) AS pending, bool_and(complete) AS c FROM o GROUP BY source)
SELECT source, discovered, fetched, failed, blocked, pending, CASE WHEN blocked = discovered THEN 'blocked' WHEN NOT c OR pending > 0 THEN 'incomplete' WHEN failed > 0 THEN 'complete-with-failures' ELSE 'complete' END AS status FROM s""")  # fmt: skip
def product_snapshot(spark, d):
    """Three parts' outcomes, one URL in several of them, merged to the state of each source."""
    source, url = F.col("o_custkey") % 50, F.col("o_orderkey")
    rows = table(spark, d, "orders").select(source.alias("source"), url.alias("url"), (source != 7).alias("complete"), F.when(source == 3, "blocked").when(url % 97 == 0, "failed").when((url % 89 == 0) & (source < 25), None).otherwise("fetched").alias("outcome"))
    told = rows.where("outcome is not null")
    again = told.where("url % 4 = 1").withColumn("outcome", F.lit("failed"))
    return collection.snapshot(rows, [told.where("url % 2 = 0"), told.where("url % 2 = 1"), again])


__all__ = ["ORACLE_SQL", "QUERIES"]
