"""Registered queries of the engine's own operators over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import identity, measure
from .functions import text as tx
from .functions.workers import ready
from .operators import classify, evidence, numbering, publish, scope, scoring, search, signals, site, tables, validation
from .plans import flagship as plan
from .sources import documents as files

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_ITEMS_SQL = """
stock AS (SELECT l_partkey, CASE WHEN bool_or(l_returnflag = 'A') THEN CASE WHEN count(DISTINCT l_suppkey) >= 10 THEN 'verified' ELSE 'likely' END
  WHEN bool_and(l_returnflag = 'R') THEN 'unavailable' ELSE 'unknown' END AS state FROM lineitem GROUP BY l_partkey),
per AS (SELECT l_orderkey, avg(CASE WHEN l_linenumber <= 4 THEN c END) AS required, avg(CASE WHEN l_linenumber > 4 THEN c END) AS optional, bool_or(l_linenumber > 4) AS has_optional,
  bool_or(l_linenumber <= 4 AND state = 'unknown' AND l_quantity >= 45) AS unknown_main, count(*) AS n_items, count(*) FILTER (state = 'verified') AS n_verified, count(*) FILTER (state = 'unknown') AS n_unknown,
  bool_or(p_size >= 25) AS protein, bool_or(l_discount > 0.05) AS vegetable, bool_or(l_quantity > 40) AS staple, avg(CASE WHEN l_discount > 0.08 THEN 1.0 ELSE 0.0 END) AS processed,
  max(CAST(l_shipdate AS DATE)) - min(CAST(l_shipdate AS DATE)) AS spread
  FROM (SELECT *, CASE WHEN state IN ('verified', 'likely') THEN 1.0 ELSE 0.35 END AS c FROM lineitem JOIN stock USING (l_partkey) JOIN part ON p_partkey = l_partkey) GROUP BY l_orderkey),
raw AS (SELECT o_orderkey, o_custkey, o_orderstatus, n_items, n_verified, n_unknown,
  35 * ((1 - CASE WHEN has_optional THEN 0.05 ELSE 0 END) * coalesce(required, 0) + CASE WHEN has_optional THEN 0.05 ELSE 0 END * coalesce(optional, 0)) * CASE WHEN unknown_main THEN 0.7 ELSE 1 END
  + 25 * (CASE WHEN spread > 0 THEN 0.65 * 0.65 + 0.35 * CASE WHEN spread <= 30 THEN 1 WHEN spread <= 45 THEN 0.9 WHEN spread <= 60 THEN 0.75 WHEN spread <= 120 THEN 0.5 ELSE 0.3 END ELSE 0.65 END)
  + 25 * (0.45 * protein::INT + 0.35 * vegetable::INT + 0.15 * staple::INT + 0.05 * (protein AND vegetable)::INT) * CASE WHEN processed >= 0.25 THEN 0.7 ELSE 1 END
  + 15 * (0.4 * greatest(0, least(1, (22 - n_items) / 14.0)) + 0.35 * greatest(0, least(1, (18 - n_items) / 12.0)) + 0.2 * greatest(0.3, 0.9 - 0.3) + 0.05) AS total
  FROM orders JOIN per ON o_orderkey = l_orderkey),
scored AS (SELECT *, round(CAST(CASE WHEN o_orderstatus <> 'P' THEN total ELSE least(total, CASE WHEN n_items < 2 THEN 39 ELSE 59 END) END AS DOUBLE), 3) AS score FROM raw),
banded AS (SELECT *, CASE WHEN score >= 90 THEN '90+' WHEN score >= 80 THEN '80s' WHEN score >= 70 THEN '70s' WHEN score >= 60 THEN '60s' ELSE '<60' END AS band,
  CASE WHEN o_orderstatus <> 'P' AND score >= 60 THEN 'approved' WHEN n_items < 2 THEN 'rejected' ELSE 'needs-review' END AS status,
  row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey) = 1 AS discovery_representative FROM scored)
"""


def _scored(spark, d):
    return plan.scored_records(table(spark, d, "orders"), table(spark, d, "lineitem"), table(spark, d, "part"))


@query(f"WITH {_ITEMS_SQL} SELECT o_orderkey, o_custkey, score, band, status, n_items, n_verified, n_unknown FROM banded WHERE discovery_representative ORDER BY score DESC, o_orderkey LIMIT 100")
def score_flagship(spark, d):
    return plan.flagship(table(spark, d, "orders"), table(spark, d, "lineitem"), table(spark, d, "part"))


@query(f"WITH {_ITEMS_SQL} SELECT band, status, count(*) AS n FROM banded GROUP BY band, status")
def score_bands(spark, d):
    return _scored(spark, d).groupBy("band", "status").agg(F.count("*").alias("n"))


@query("SELECT 'first' AS side, p_partkey AS o_orderkey FROM part WHERE false")
def rerun_determinism(spark, d):
    return tables.same_rows(_scored(spark, d), _scored(spark, d)).select("side", "o_orderkey")


@query("SELECT p_partkey, substr(sha256('[\"' || p_brand || '\", \"' || p_name || '\"]'), 1, 24) AS id FROM part")
def stable_ids(spark, d):
    return table(spark, d, "part").select("p_partkey", identity.stable_id(F.col("p_brand"), F.col("p_name")).alias("id"))


@query("""WITH s AS (SELECT doc_id, text FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, text FROM documents WHERE doc_id % 3 > 0 UNION ALL
SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END FROM documents WHERE doc_id % 5 = 0)
SELECT doc_id, count(DISTINCT text) AS versions FROM s GROUP BY doc_id HAVING count(DISTINCT text) > 1""")
def merge_shards_conflicts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    again = docs.where("doc_id % 5 = 0").withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return tables.merge_shards([docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 > 0"), again], "doc_id")[1]


@query("""SELECT o_orderkey, rule FROM (SELECT o_orderkey, 'price_over_1000' AS rule FROM orders WHERE NOT coalesce(o_totalprice > 1000, false)
UNION ALL SELECT o_orderkey, 'status_known' FROM orders WHERE NOT coalesce(o_orderstatus IN ('O', 'F'), false) UNION ALL SELECT o_orderkey, 'priority_form' FROM orders WHERE NOT coalesce(regexp_matches(o_orderpriority, '^[1-4]-'), false))""")
def schema_violations(spark, d):
    return tables.violations(table(spark, d, "orders"), "o_orderkey", {"price_over_1000": F.col("o_totalprice") > 1000, "status_known": F.col("o_orderstatus").isin("O", "F"), "priority_form": F.col("o_orderpriority").rlike("^[1-4]-")})


def _work(spark, d):
    items = table(spark, d, "lineitem")
    return table(spark, d, "orders").select("o_orderkey"), items.where("l_linestatus = 'F' and l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey")), items.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))


_PENDING = "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F' AND l_linenumber = 1)"


@query(_PENDING + " AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def pending_items(spark, d):
    return tables.pending(*_work(spark, d), "o_orderkey")


@query(_PENDING)
def retry_pending(spark, d):
    return tables.pending(*_work(spark, d), "o_orderkey", retry=True)


@query("SELECT l_orderkey, count(DISTINCT l_suppkey) AS owners FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) > 1")
def ownership_collisions(spark, d):
    return tables.ownership_collisions(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_check(spark, d):
    return tables.orphans(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("SELECT s_suppkey, CAST((row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1) % 7 AS INTEGER) AS bin FROM supplier")
def round_robin_plan(spark, d):
    return tables.round_robin(table(spark, d, "supplier"), 7, F.desc("s_acctbal"), F.col("s_suppkey")).select("s_suppkey", "bin")


@query("SELECT p_partkey, p_brand, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 200 AS chunk FROM part")
def chunk_200(spark, d):
    return tables.chunks(table(spark, d, "part"), 200, ["p_brand"], F.col("p_partkey")).select("p_partkey", "p_brand", "chunk")


@query("""WITH RECURSIVE unit AS (SELECT l_suppkey, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, l_suppkey) AS k FROM lineitem GROUP BY l_suppkey),
step AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS l_suppkey, -1 AS bin, [0, 0, 0, 0]::BIGINT[] AS loads
  UNION ALL SELECT u.k, u.l_suppkey, CAST(list_position(s.loads, list_min(s.loads)) - 1 AS INTEGER), list_transform(s.loads, lambda x, i: x + CASE WHEN i = list_position(s.loads, list_min(s.loads)) THEN u.size ELSE 0 END)
  FROM step AS s JOIN unit AS u ON u.k = s.k + 1)
SELECT l_suppkey, bin FROM step WHERE k > 0""")
def least_loaded_plan(spark, d):
    units = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("size"))
    return tables.least_loaded(units, "l_suppkey", "size", 4)


@query("SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def first_claim(spark, d):
    return tables.first_claim(table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber"), "l_partkey", F.col("l_orderkey"), F.col("l_linenumber"))


def _groups(spark, d):
    docs = table(spark, d, "documents")
    name = F.regexp_replace(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "), "^ | $", "")
    return tables.duplicate_groups(docs.select("doc_id", F.sha2(F.concat_ws("|", "lang", name), 256).alias("fingerprint")), "fingerprint", "doc_id")


_GROUPS = "SELECT sha256(lang || '|' || regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), '^ | $', '', 'g')) AS fingerprint, min(doc_id) AS representative, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids, count(*) AS size FROM documents GROUP BY 1"


@query(_GROUPS)
def exact_duplicates(spark, d):
    return _groups(spark, d).withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


@query(f"SELECT count(*) AS groups, count(*) FILTER (size > 1) AS multi_member_groups, CAST(sum(size - 1) AS BIGINT) AS duplicate_records FROM ({_GROUPS})")
def duplicate_manifest(spark, d):
    return tables.duplicate_manifest(_groups(spark, d))


@query("""SELECT l_partkey, CASE WHEN bool_or(l_returnflag = 'A') THEN true WHEN bool_and(l_returnflag = 'R') THEN false END AS available, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS product_ids,
count(*) AS n_products, max(l_orderkey) AS last_observed, min_by(l_linestatus, l_orderkey * 100 + l_linenumber) AS category FROM lineitem GROUP BY l_partkey""")
def tri_state_inventory(spark, d):
    """Of several first rows the one that comes first in the files counts; nulls are passed over as SQL's aggregates do."""
    flag, place = F.col("l_returnflag"), F.col("l_orderkey") * 100 + F.col("l_linenumber")
    lines = numbering.placed(table(spark, d, "lineitem"), "l_partkey", F.col("l_suppkey").cast("string").alias("product"), F.when(flag == "A", True).when(flag == "R", False).alias("stock"), flag.isNotNull().alias("says"), "l_orderkey", "l_linestatus", place.alias("at"))
    rows = lines.withColumn("place", F.when(F.col("at").isNotNull() & F.col("l_linestatus").isNotNull(), F.struct("at", "file", "row")))
    out = evidence.rollup(rows, "l_partkey", "product", "product", "stock", "l_orderkey", "l_linestatus", "place", "says")
    return out.drop("names").withColumn("product_ids", F.when(F.size("product_ids") > 0, F.array_join("product_ids", ",")))


@query("""SELECT l_partkey, l_suppkey, n FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_suppkey) AS r FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE r = 1""")
def evidence_winner(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    return evidence.winners(rows, "l_partkey", F.col("n"), F.col("l_suppkey"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 11 = 0 THEN 'unknown'
WHEN (s_suppkey % 3 <> 1 OR s_suppkey % 7 = 0) AND s_acctbal > 5000 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'likely_available' ELSE 'unknown' END
WHEN s_acctbal < 0 AND s_suppkey % 3 = 1 AND s_suppkey % 7 <> 0 THEN 'unavailable' WHEN s_acctbal > 5000 THEN 'verified_available'
WHEN s_suppkey % 5 = 0 AND s_suppkey % 2 = 0 THEN 'likely_available' ELSE 'unknown' END AS state FROM supplier""")
def evidence_state(spark, d):
    k = F.col("s_suppkey")
    proof = F.struct(F.when(k % 2 == 0, "https://shop.example.com/p").otherwise("https://other.example.org/p").alias("source_url"), F.lit("2024-01-01T00:00:00-05:00").alias("retrieved_at"), F.lit("9").alias("store_id"), F.lit("other_store").alias("store_specificity"))
    entry = F.struct(
        F.when(k % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(k.cast("string"))).alias("product_ids"), F.when(k % 5 == 0, "likely_available").otherwise("unknown").alias("status"),
        F.when(F.col("s_acctbal") > 5000, True).when(F.col("s_acctbal") < 0, False).alias("currently_available"), F.when(k % 3 == 1, "1").otherwise("2").alias("store_id"),
        F.when(k % 7 == 0, "national_catalog").otherwise("specific_store").alias("store_specificity"), F.lit("s1").alias("snapshot_id"), F.lit("2024-01-01").alias("verified_at"), F.array(proof).alias("evidence"),
    )
    return table(spark, d, "supplier").select("s_suppkey", evidence.evidence_state(entry, F.lit("1"), lambda u: tx.host_within(u, "example.com")).alias("state"))


_RULES = [("http://blog.", "blog"), ("brand#", "any"), ("brand#1", "one"), ("brand#2", "two"), ("brand", "none")]


@query("SELECT p_partkey, rule FROM (SELECT *, lower(p_brand) AS slug FROM part) JOIN (VALUES ('brand#', 'any'), ('brand#1', 'one'), ('brand#2', 'two'), ('brand', 'none')) AS r(prefix, rule) ON starts_with(slug, prefix) AND regexp_matches(substr(slug, length(prefix) + 1, 1), '[0-9]')")
def prefix_rule_join(spark, d):
    rules = spark.createDataFrame(_RULES, "prefix string, rule string")
    return evidence.prefix_rules(table(spark, d, "part").select("p_partkey", F.lower("p_brand").alias("slug")), rules).select("p_partkey", "rule")


@query("SELECT l_orderkey, round(avg(CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END), 6) AS coverage, count(*) FILTER (l_returnflag = 'A') AS available, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def coverage_ratio(spark, d):
    return tables.share(table(spark, d, "lineitem"), ["l_orderkey"], F.col("l_returnflag") == "A").withColumnRenamed("covered", "available")


@query("SELECT o_orderkey, CASE WHEN o_totalprice <= 50000 THEN 1.0 WHEN o_totalprice <= 100000 THEN 0.8 WHEN o_totalprice <= 200000 THEN 0.6 ELSE 0.4 END::DOUBLE AS credit FROM orders")
def banded_credit(spark, d):
    return table(spark, d, "orders").select("o_orderkey", scoring.banded(F.col("o_totalprice"), ((50000, 1), (100000, 0.8), (200000, 0.6), (400000, 0.4))).alias("credit"))


@query("SELECT o_orderkey, round(greatest(0, least(1, (300000.0 - o_totalprice) / 250000)), 6) AS credit FROM orders")
def falling_credit(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(scoring.falling(F.col("o_totalprice"), 50000, 300000), 6).alias("credit"))


@query("SELECT l_orderkey, l_partkey AS item, l_quantity AS amount FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey DESC) AS r FROM lineitem) WHERE r = 1")
def argmax_item(spark, d):
    return tables.greatest_of_each(table(spark, d, "lineitem"), ["l_orderkey"], "l_quantity", "l_partkey").withColumnsRenamed({"l_partkey": "item", "l_quantity": "amount"})


@query("SELECT p_partkey, p_size > 3 AND row_number() OVER (PARTITION BY lower(p_name), p_size > 3 ORDER BY p_retailprice DESC, p_partkey) = 1 AS discovery_representative FROM part")
def discovery_representative(spark, d):
    return tables.discovery_representative(table(spark, d, "part"), F.lower("p_name"), [F.desc("p_retailprice"), F.col("p_partkey")], F.col("p_size") > 3).select("p_partkey", "discovery_representative")


@query("SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_retailprice DESC, lower(p_name), p_partkey) AS INTEGER) AS position, CAST(least(3, ceil((SELECT count(*) FROM part) / 120.0)) AS INTEGER) AS page, CAST(ceil((SELECT count(*) FROM part) / 120.0) AS INTEGER) AS pages FROM part QUALIFY position BETWEEN page * 120 - 119 AND page * 120")
def catalog_order_page(spark, d):
    return tables.page(table(spark, d, "part"), [F.desc("p_retailprice"), F.lower("p_name"), F.col("p_partkey")], 3).select("p_partkey", "position", "page", "pages")


@query("SELECT axis, label, count(*) AS n FROM (SELECT 'brand' AS axis, p_brand AS label FROM part UNION ALL SELECT 'type', unnest(string_split(p_type, ' ')) FROM part) GROUP BY ALL")
def facet_counts(spark, d):
    return tables.facet_counts(table(spark, d, "part"), {"brand": F.array("p_brand"), "type": F.split("p_type", " ")})


@query("""SELECT label, count(*) AS n FROM (SELECT unnest(CASE WHEN p_size > 0 THEN list_filter([CASE WHEN p_size < 15 THEN 'Under 15 min' END, CASE WHEN p_size < 30 THEN 'Under 30 min' END, CASE WHEN p_size BETWEEN 30 AND 45 THEN '30–45 min' END,
CASE WHEN p_size > 45 AND p_size <= 60 THEN '45–60 min' END, CASE WHEN p_size > 60 THEN 'Over 60 min' END], lambda x: x IS NOT NULL) ELSE ['Unknown'] END) AS label FROM part) GROUP BY label""")
def overlapping_buckets(spark, d):
    return table(spark, d, "part").select(F.explode(tables.time_buckets(F.col("p_size"))).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, o_orderkey, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 20")
def cohort_topk(spark, d):
    return tables.top_of_each(table(spark, d, "orders"), [F.col("o_orderpriority")], [F.desc("o_totalprice"), F.col("o_orderkey")], 20).select("o_orderpriority", "o_orderkey", "rank")


@query("SELECT o_orderpriority, o_orderkey, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS rank FROM orders) WHERE rank <= 20")
def bottom_cohort(spark, d):
    return tables.top_of_each(table(spark, d, "orders"), [F.col("o_orderpriority")], [F.col("o_totalprice"), F.col("o_orderkey")], 20).select("o_orderpriority", "o_orderkey", "rank")


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word ORDER BY n DESC, word LIMIT 80")
def top_unresolved(spark, d):
    return tables.most_frequent(table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")), "word", 80)


@query("SELECT 'quality' AS column_name, count(*) FILTER (quality IS NULL) AS nulls FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'toxic', count(*) FILTER (toxic IS NULL) FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'text', count(*) FILTER (text IS NULL) FROM documents")
def audit_nulls(spark, d):
    return tables.null_counts(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left"), ["quality", "toxic", "text"])


@query("SELECT source, CASE WHEN source = 'src7' THEN 'BLOCKED' WHEN count(*) FILTER (quality IS NULL) > 0 OR count(*) FILTER (quality = 0) > 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS status FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def coverage_status(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").groupBy("source").agg(F.count_if(F.col("quality").isNull()).alias("pending"), F.count_if(F.col("quality") == 0).alias("failed"))
    return rows.select("source", tables.coverage_status(F.col("pending"), F.col("failed"), F.lit(0), F.when(F.col("source") == "src7", "discovery failed")).alias("status"))


@query("SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def breakdown_sets(spark, d):
    return tables.breakdown(table(spark, d, "documents"), ["lang", "source"])


_LINE = "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS q, CASE l_linenumber % 4 WHEN 0 THEN 'tbsp' WHEN 1 THEN 'cups' WHEN 2 THEN 'tsp' ELSE 'kg' END AS u, CASE l_linenumber % 4 WHEN 0 THEN 15 WHEN 1 THEN 240 WHEN 2 THEN 5 ELSE 1 END AS f, CASE WHEN l_linenumber % 4 = 3 THEN 'kg' ELSE 'mL' END AS m FROM lineitem"


def _lines(spark, d):
    unit = F.element_at(F.array(*map(F.lit, ("tbsp", "cups", "tsp", "kg"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"), unit.alias("u"))


@query(f"SELECT l_orderkey, l_linenumber, CAST(q * f + 0.5 * f AS DOUBLE) AS amount FROM ({_LINE})")
def measure_lines(spark, d):
    text = F.concat(F.col("q").cast("string"), F.lit(" 1/2 "), "u", F.lit(" of it"))
    found = F.regexp_extract(measure.metric_text(text), "^([0-9.]+)", 1).cast("double")
    return _lines(spark, d).select("l_orderkey", "l_linenumber", found.alias("amount"))


@query(f"SELECT l_orderkey, l_linenumber, 'Add ' || (q * f) || ' ' || m || ' oil, then ' || (2 * q * f) || ' ' || m AS said FROM ({_LINE})")
def metric_rewrite(spark, d):
    q = F.col("q")
    text = F.concat(F.lit("Add "), q.cast("string"), F.lit(" "), "u", F.lit(" oil, then "), (2 * q).cast("string"), "u", F.lit("."))
    return _lines(spark, d).select("l_orderkey", "l_linenumber", measure.metric_text(text).alias("said"))


@query("""SELECT l_orderkey, max(CASE l_linenumber % 3 WHEN 0 THEN q * 60 WHEN 1 THEN q END)::DOUBLE AS lower_bound, coalesce(max(CASE l_linenumber % 3 WHEN 0 THEN q * 60 WHEN 1 THEN q END) >= 1440, false) AS advance,
coalesce(max(CASE l_linenumber % 3 WHEN 0 THEN q * 60 WHEN 1 THEN q END) > 600, false) AS conflict FROM (SELECT *, CAST(l_quantity AS INTEGER) AS q FROM lineitem) GROUP BY l_orderkey""")
def duration_bounds(spark, d):
    q = F.col("l_quantity").cast("int").cast("string")
    step = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("Simmer for "), q, F.lit(" hours."))).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("Bake "), q, F.lit("-99 min"))).otherwise(F.concat(F.lit("Store leftovers and cook within "), q, F.lit(" days")))
    rows = table(spark, d, "lineitem").select("l_orderkey", step.alias("step")).groupBy("l_orderkey").agg(F.collect_list("step").alias("steps"))
    return rows.select("l_orderkey", measure.timing(F.col("steps"), F.lit(600)).alias("t")).select("l_orderkey", "t.*")


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size WHEN 2 THEN p_size END::DOUBLE AS servings FROM part")
def servings_parse(spark, d):
    n = F.col("p_size").cast("string")
    text = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("Serves "), n)).when(F.col("p_size") % 4 == 1, F.concat(n, F.lit(" people"))).when(F.col("p_size") % 4 == 2, n).otherwise(F.concat(n, F.lit(" or so")))
    return table(spark, d, "part").select("p_partkey", measure.servings(text).alias("servings"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_size * 60 + 30 WHEN 1 THEN p_size END::DOUBLE AS minutes FROM part")
def iso_minutes(spark, d):
    n = F.col("p_size").cast("string")
    text = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("PT"), n, F.lit("H30M"))).when(F.col("p_size") % 3 == 1, F.concat(n, F.lit(" mins"))).otherwise(F.concat(F.lit("about "), n))
    return table(spark, d, "part").select("p_partkey", measure.iso_minutes(text).alias("minutes"))


_TERMS = ("the", "of")


@query("""WITH t AS (SELECT doc_id, trim(regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-z0-9]+', ' ', 'g')) AS title, list_transform(string_split(text, '.'), lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))) AS items,
  trim(regexp_replace(lower(lang || ' ' || source || ' ' || text), '[^a-z0-9]+', ' ', 'g')) AS meta FROM documents),
h AS (SELECT *, contains(' ' || title || ' ', ' the of ') OR starts_with(title, 'the of') AS strong, title = 'the of' AS exact, len(list_filter(items, lambda x: contains(' ' || x || ' ', ' the '))) > 0 AS a, len(list_filter(items, lambda x: contains(' ' || x || ' ', ' of '))) > 0 AS b FROM t)
SELECT doc_id, a::INT + b::INT AS n_items, CASE WHEN exact THEN 0 WHEN strong THEN 1 WHEN a AND b THEN 2 WHEN a OR b THEN 3 ELSE 4 END AS priority FROM h
WHERE ((a OR contains(' ' || meta || ' ', ' the ')) AND (b OR contains(' ' || meta || ' ', ' of '))) OR strong OR exact""")
def search_ranked(spark, d):
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    docs = table(spark, d, "documents")
    items = F.transform(F.split("text", r"\."), lambda x: F.struct(plain(x).alias("canonical"), F.array().cast("array<string>").alias("terms")))
    rows = docs.select("doc_id", plain(F.split("text", "\n")[0]).alias("title"), items.alias("items"), plain(F.concat_ws(" ", "lang", "source", "text")).alias("meta"))
    return search.rank(rows, search.parse_query(list(_TERMS), {}, {}), [F.col("title")], F.col("items"), F.col("meta")).select("doc_id", "n_items", "priority")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def hidden_excluded(spark, d):
    hidden = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("p_partkey"))
    return tables.without_hidden(table(spark, d, "part").select("p_partkey"), hidden, "p_partkey")


@query("SELECT p_partkey FROM part WHERE list_contains(string_split(p_type, ' '), 'PROMO') AND p_size = 21")
def facet_filter(spark, d):
    return tables.facet_filter(table(spark, d, "part").select("p_partkey", "p_size", F.split("p_type", " ").alias("types")), {"types": "PROMO", "p_size": 21}).select("p_partkey")


@query("SELECT page_id, regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 's') AS title FROM pages")
def page_title(spark, d):
    return table(spark, d, "pages").select("page_id", tx.page_title(F.col("html")).alias("title"))


@query("""WITH bare AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages)
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&#233;', 'é'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g')) AS visible FROM bare""")
def visible_text(spark, d):
    return table(spark, d, "pages").select("page_id", tx.visible_text(F.col("html")).alias("visible"))


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN url ELSE 'https://fallback.example.com/' || page_id END AS url FROM pages")
def safe_url(spark, d):
    bad = F.when(F.col("page_id") % 5 == 0, F.col("url")).when(F.col("page_id") % 5 == 1, F.concat(F.lit("https://user@"), "url")).when(F.col("page_id") % 5 == 2, F.replace("url", F.lit("/"), F.lit("\\"))).when(F.col("page_id") % 5 == 3, F.lit("https://a.example.com:99999/"))
    return table(spark, d, "pages").select("page_id", tx.safe_url(bad, F.concat(F.lit("https://fallback.example.com/"), F.col("page_id").cast("string"))).alias("url"))


_TRIAGED = (
    ("x.md.gz", "https://u\nAccess Denied", "BLOCKED", "captured-access-or-missing-page"),
    ("x.md", "# Title\nTODO", "NOT_A_RECIPE_SOURCE", "duplicate/non-recipe-file"),
    ("x.md", "%INGREDIENT_NAME% and more", "NOT_A_RECIPE_SOURCE", "repository-metadata"),
    ("x.gz", "https://u\nshort", "UNSUPPORTED", "incomplete-cached-content"),
    ("x.html", "<p>text</p>", "UNSUPPORTED", "HTML"),
    ("x.gz", "https://u\nIngredients\n" + "long text " * 40, "LEGITIMATE_RECIPE_FAILURE", "instructions-parser-failure"),
    ("x.gz", "https://u\n" + "long text " * 40, "UNSUPPORTED", "unlabelled-or-index-archive"),
    ("x.md", "Some text\n## Ingredients\nmore", "LEGITIMATE_RECIPE_FAILURE", "alternate-markdown-layout"),
    ("x.md", "Some text", "UNSUPPORTED", "other"),
)


@query("SELECT outcome, cause, count(*) AS n FROM pages JOIN (VALUES " + ", ".join(f"({k}, '{o}', '{c}')" for k, (_, _, o, c) in enumerate(_TRIAGED)) + ") AS v(k, outcome, cause) ON k = page_id % 9 GROUP BY outcome, cause")
def triage_pages(spark, d):
    """Nine captured texts, one for each way to fail, dealt over the pages."""
    path, text = (F.element_at(F.array(*(F.lit(x[k]) for x in _TRIAGED)), (F.col("page_id") % 9 + 1).cast("int")) for k in (0, 1))
    return table(spark, d, "pages").select(classify.triage(text, path).alias("t")).groupBy("t.outcome", "t.cause").agg(F.count("*").alias("n"))


@query("SELECT doc_id, count(*) FILTER (noise) AS dropped, count(*) FILTER (NOT noise) AS kept FROM (SELECT doc_id, length(l) < 20 AS noise FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)) GROUP BY doc_id")
def noise_rows_audit(spark, d):
    kept, gone = publish.split_noise(table(spark, d, "documents"), "doc_id", F.split("text", "\n"), "(?s)^.{0,19}$")
    return kept.select("doc_id", F.lit(0).alias("gone")).unionByName(gone.select("doc_id", F.lit(1).alias("gone"))).groupBy("doc_id").agg(F.count_if(F.col("gone") == 1).alias("dropped"), F.count_if(F.col("gone") == 0).alias("kept"))


@query("SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN '' ELSE text END AS said FROM conversations")
def redact_publish(spark, d):
    rows = table(spark, d, "conversations").withColumns({"lines": F.split("text", "\n"), "secret": F.lit("x")})
    out = publish.publish(rows, ["conv_id", "turn", "role", "lines"], redact={"lines": F.col("role") != "assistant"})
    return out.select("conv_id", "turn", "role", F.array_join("lines", "\n").alias("said"))


@query("SELECT event_id, json_extract_string(props, '$.' || (json_keys(props)[1])) AS value, json_keys(props)[1] AS key FROM events")
def json_payload(spark, d):
    rows = table(spark, d, "events").withColumn("key", F.get(F.json_object_keys("props"), F.lit(0)))
    return rows.select("event_id", "key", F.element_at(F.from_json("props", "map<string,string>"), F.col("key")).alias("value"))


@query("SELECT user_id, event_type, count(*) AS n, count(*) FILTER (value > 50) AS large FROM events GROUP BY ALL")
def event_rollup(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("large"))


@query("SELECT p_partkey, p_name LIKE '%a%' AND p_name NOT LIKE '%b_e%' AS selected FROM part")
def path_globs(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.path_selected(F.col("p_name"), ["*a*"], ["*b?e*"]).alias("selected"))


def _captured(spark, d):
    """part's rows as files of seven formats: the same record in each."""
    c = {k: F.col(k).cast("string") for k in ("p_name", "p_brand", "p_type", "p_size", "p_partkey")}
    say = lambda *parts: F.concat(*(c[x] if x in c else F.lit(x) for x in parts))
    markup = ("<html><title>", "p_name", "</title>")
    formats = [
        (".md", say("# ", "p_name", "\n## Ingredients\n- ", "p_size", " g ", "p_type", "\n- ", "p_brand", "\n## Method\n1. Mix.\n2. Serve to ", "p_partkey", ".\n")),
        (".json", say('{"app": [{"name": "', "p_name", '", "recipeIngredient": ["', "p_size", " g ", "p_type", '", "', "p_brand", '"], "recipeInstructions": [{"text": "Mix."}, {"text": "Serve to ', "p_partkey", '."}]}]}')),
        (".html", say('<html><script type="application/ld+json">{"name": "', "p_name", '", "ingredients": ["', "p_size", " g ", "p_type", '", "', "p_brand", '"], "instructions": "Mix.\\nServe to ', "p_partkey", '."}</script></html>')),
        (".htm", say(*markup, '<ul><li itemprop="recipeIngredient">', "p_size", " g  ", "p_type", '</li><li itemprop="recipeIngredient">', "p_brand", '</li></ul><p itemprop="recipeInstructions">Mix.</p><p itemprop="recipeInstructions">Serve to ', "p_partkey", ".</p></html>")),
        (".html", say(*markup, '<b class="ingredient">', "p_size", " g ", "p_type", '</b><b class="ingredient">', "p_brand", '</b><p class="instruction">Mix.<p class="instruction">Serve to ', "p_partkey", ".</p></p></html>")),
        (".csv", say('Title, Ingredients ,Directions\n', "p_name", ',"', "p_size", " g ", "p_type", "\n", "p_brand", '","Mix.\nServe to ', "p_partkey", '."\n')),
        (".md", say("p_name", "\n===\n\nServes 4\n* ", "p_size", " g ", "p_type", "\n* ", "p_brand", "\n\nMix.\n\nServe to ", "p_partkey", ".\n\nSource: x\n")),
    ]
    kind = F.col("p_partkey") % len(formats)
    text, ending = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (end, body) in enumerate(formats):
        text, ending = F.when(kind == k, body).otherwise(text), F.when(kind == k, end).otherwise(ending)
    return table(spark, d, "part").select("p_partkey", F.concat(c["p_partkey"], ending).alias("path"), text.alias("content"))


@query("""SELECT p_partkey, 0 AS file_position, p_name AS title, p_size || ' g ' || p_type || '|' || p_brand AS items, CASE WHEN p_partkey % 7 = 4 THEN 'Serve to ' || p_partkey || '.|Mix. Serve to ' || p_partkey || '.' ELSE 'Mix.|Serve to ' || p_partkey || '.' END AS steps FROM part""")
def parse_formats(spark, d):
    rows = files.records(files.parse_documents(_captured(spark, d), F.col("path"), F.col("content")), ["p_partkey"])
    return rows.select("p_partkey", "file_position", "title", F.array_join("ingredients", "|").alias("items"), F.array_join("instructions", "|").alias("steps"))


@query("SELECT page_id, page_id % 3 = 2 AS failed, CASE page_id % 3 WHEN 0 THEN 'Soup ' || page_id WHEN 1 THEN 'Pie ' || page_id END AS title, CASE WHEN page_id % 3 < 2 THEN 2 ELSE 0 END AS n_items FROM pages")
def parse_pages(spark, d):
    """Pages with linked data, with microdata, and with neither, after the pages' own markup, which some leave open."""
    k = F.col("page_id").cast("string")
    linked = F.concat(F.lit('<script type="application/ld+json">{"@type": "Recipe", "name": "Soup '), k, F.lit('", "recipeIngredient": ["1 leek", "2 carrots"], "recipeInstructions": ["Cut.", "Cook."]}</script>'))
    micro = F.concat(
        F.lit('<div itemscope itemtype="http://schema.org/Recipe"><h1 itemprop="name">Pie '), k,
        F.lit('</h1><p itemprop="recipeIngredient">3 apples</p><p itemprop="recipeIngredient">dough</p><p itemprop="recipeInstructions">Bake it.</p></div>'),
    )
    part = F.when(F.col("page_id") % 3 == 0, linked).when(F.col("page_id") % 3 == 1, micro).otherwise(F.lit(""))
    pages = table(spark, d, "pages").select("page_id", F.concat("html", part).alias("html"))
    parsed = files.parse_documents(pages, F.concat(k, F.lit(".html")), F.col("html"))
    first = F.get("parsed.records", F.lit(0))
    return parsed.select("page_id", F.col("parsed.error").isNotNull().alias("failed"), first["title"].alias("title"), F.coalesce(F.size(first["ingredients"]), F.lit(0)).alias("n_items"))


@query("""SELECT o_orderkey, k * 2 + 1 AS operations, CASE WHEN k % 3 = 0 THEN 'bowl,pan' ELSE 'pan' END AS vessels, CASE WHEN k % 3 = 0 THEN 3 ELSE 2 END AS vessel_count, greatest(CASE WHEN k % 2 = 0 THEN 60.0 * (k + 1) ELSE 0 END, 10.0 + k)::DOUBLE AS lower_bound, k % 5 = 0 AS advance
FROM (SELECT o_orderkey, CAST(o_orderkey % 12 AS INTEGER) AS k FROM orders)""")
def practical_signals(spark, d):
    k = (F.col("o_orderkey") % 12).cast("int")
    n = lambda c: c.cast("string")
    steps = F.array(
        F.concat(F.repeat(F.lit("chop and whisk "), k), F.lit("it in the pan. Use another large pan and stir.")), F.concat(F.lit("Bake "), n(k + 10), F.lit("-99 minutes")),
        F.when(k % 2 == 0, F.concat(F.lit(". Chill for "), n(k + 1), F.lit(" hours. "))).otherwise(". It keeps for 90 hours, chill it. "), F.when(k % 5 == 0, "Marinate overnight.").otherwise("Done."), F.when(k % 3 == 0, "The bowl is hot").otherwise(""),
    )
    rows = signals.with_practical(table(spark, d, "orders").select("o_orderkey", steps.alias("steps")), F.col("steps"), "s")
    return rows.select("o_orderkey", "s.operations", F.array_join("s.vessels", ",").alias("vessels"), "s.vessel_count", "s.lower_bound", "s.advance")


@query("""SELECT l_orderkey, arg_max(name, (m, w, name)) AS major FROM (SELECT l_orderkey, 'p' || l_partkey AS name, CASE WHEN l_linenumber % 3 = 0 THEN l_quantity * 1000 WHEN l_linenumber % 3 = 1 THEN l_quantity ELSE 0 END AS m,
CASE l_linenumber % 2 WHEN 0 THEN 5 ELSE 1 END AS w FROM lineitem) GROUP BY l_orderkey""")
def major_protein(spark, d):
    n = F.col("l_linenumber")
    item = F.struct(
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("name"), F.when(n % 2 == 0, "meat").otherwise("dairy").alias("category"), F.col("l_quantity").cast("double").alias("quantity"),
        F.when(n % 3 == 0, "kg").when(n % 3 == 1, "g").alias("unit"), F.lit(True).alias("protein"),
    )
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("items"))
    return rows.select("l_orderkey", signals.major_protein(F.col("items")).alias("major"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN p_size > 20 WHEN 4 THEN true ELSE false END AS candidate FROM part""")
def scope_of_paths(spark, d):
    k, name = F.col("p_partkey") % 6, F.replace("p_name", F.lit(" "), F.lit("-"))
    path = F.when(k == 0, F.concat(F.lit("docs/"), name, F.lit(".zip"))).when(k == 1, F.concat(F.lit("docs/"), name, F.lit(".md"))).when(k == 2, F.concat(F.lit("a/"), name, F.lit(".md")))
    path = path.when(k == 3, F.concat(name, F.when(F.col("p_size") > 20, "-recipe.csv").otherwise(".csv"))).when(k == 4, F.concat(F.lit("x/testdata/"), name, F.lit(".json"))).otherwise(F.lit("README.md"))
    return table(spark, d, "part").select("p_partkey", scope.may_hold_records(path).alias("candidate"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 1 THEN 'https://b.example.com/raw.png' WHEN s_suppkey % 4 = 2 AND s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 4 = 3 THEN CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'https://b.example.com/raw.png' END ELSE 'https://a.example.com/own.png' END AS url FROM supplier""")
def picture_rights(spark, d):
    k = F.col("s_suppkey")
    none = F.lit(None).cast("string")

    def image(url, name, license_, allowed, proof):
        return F.struct(url.alias("url"), F.lit("https://s.example.com/p").alias("source_url"), name.alias("attribution"), license_.alias("license"), allowed.alias("publication_allowed"), proof.alias("permission_evidence"))

    # By remainder of 4: own license; own picture refused; own permission; a license that wants a name. Each third has no proof or is another record's.
    own = image(
        F.lit("https://a.example.com/own.png"), F.when(k % 4 == 0, "A. Painter"), F.when(k % 4 == 0, "cc-by-4.0").when(k % 4 == 3, "CC-BY-4.0"), F.when(k % 4 == 1, False).when(k % 4 == 2, True),
        F.when((k % 4 == 2) & (k % 3 != 0), "https://proof.example.com/1"),
    )
    raw = image(F.lit("https://b.example.com/raw.png"), none, F.lit("CC0-1.0"), F.lit(None).cast("boolean"), none)
    mine = F.when((k % 4 == 1) | ((k % 4 == 3) & (k % 3 != 0)), F.lit(1)).otherwise(2)
    return table(spark, d, "supplier").select("s_suppkey", scope.picture(own, scope.same_identity(raw, F.lit(1), mine))["url"].alias("url"))


def _site(spark, d):
    label = F.split("p_type", " ")
    part = table(spark, d, "part")
    return part.select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("score"), F.when(F.col("p_size") > 5, F.concat(F.lit("https://x.example.com/"), F.col("p_partkey").cast("string"))).alias("source_url"),
        signals.facts(F.col("p_size").cast("double"), F.array("p_brand", F.lit("Other"))).alias("facts"), F.array("p_brand").alias("cuisines"), label.alias("meal_types"), F.array(F.lit("Other")).alias("proteins"), label.alias("methods"), tables.time_buckets(F.col("p_size")).alias("times"),
        F.array("p_type").alias("items"), F.array(F.lit("Mix & <b>")).alias("steps"), F.col("p_brand").alias("attribution"), F.lit(None).cast("string").alias("license"),
    )


@query("SELECT 'p' || p_partkey AS id, 'recipes/p' || p_partkey || '.html' AS url, p_size || ' min · ' || p_brand AS facts, p_size <= 5 AS no_source, false AS forbidden, 1 AS n_steps FROM part")
def site_pages(spark, d):
    rows = _site(spark, d)
    shown = site.detail_pages(rows).select("id", "url", "forbidden", ((F.length("html") - F.length(F.replace("html", F.lit("Mix &amp; &lt;b&gt;"), F.lit("")))) / 19).cast("int").alias("n_steps"))
    return shown.join(site.index_entries(rows).select("id", "facts", F.col("source_url").isNull().alias("no_source")), "id")


@query("SELECT count(*) AS records, count(*) FILTER (p_size <= 5) AS missing_source_urls, CAST(count(DISTINCT p_brand) AS INTEGER) AS n_cuisines, CAST(count(DISTINCT p_type) AS INTEGER) AS n_meal_types, 1 AS n_proteins, CAST(count(DISTINCT p_type) AS INTEGER) AS n_methods FROM part")
def site_manifest(spark, d):
    return site.manifest(site.index_entries(_site(spark, d))).drop("n_times")


@query("SELECT 'axis' AS \"check\", 'x' AS key WHERE false")
def site_audit(spark, d):
    rows = _site(spark, d)
    return validation.catalog_faults(site.index_entries(rows), site.detail_pages(rows), rows.select("id", F.col("id").alias("representative"), "steps"))


@query("""SELECT 'item of an unknown product' AS "check", CAST(l_orderkey AS VARCHAR) AS key FROM lineitem WHERE l_partkey % 50 = 0
UNION ALL SELECT 'product says too much', CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 50 > 0 AND p_size > 40 UNION ALL SELECT 'product of another URL', CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 50 = 7""")
def evidence_audit(spark, d):
    key = F.col("p_partkey").cast("string")
    host = F.when(F.col("p_partkey") % 50 == 7, "https://other.example.org/x/id_").otherwise("https://www.shop.example.com/x/id_")
    products = table(spark, d, "part").where("p_partkey % 50 > 0").select(
        key.alias("product_id"), F.concat(host, key).alias("source_url"), F.lit("likely_available").alias("status"), F.when(F.col("p_size") > 40, True).alias("availability"), F.lit(None).cast("string").alias("store_id"), F.lit("2024-01-01").alias("retrieved_at"),
    )
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.array(F.col("l_partkey").cast("string")).alias("product_ids"), F.lit(1).alias("n_evidence"), F.lit("likely_available").alias("status"))
    return validation.evidence_faults(products, items, lambda u: scope.public_product_id(u, "shop.example.com", "/id_([0-9]+)$"))
