"""Registered queries of operators that keep tables between steps: indexes, numbers, checksums, snapshots, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import checksums, json_schema, numbering, patterns, postings, reports, search, snapshots
from .operators.storage import hadoop, shared
from .queries import table
from .record_queries import ORACLE_SQL, QUERIES, query  # noqa: F401
from .streaming import attempts

LATE_PAGE = 417


@query(f"""WITH n AS (SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS position, CAST(ceil(count(*) OVER () / 120.0) AS INTEGER) AS pages FROM lineitem)
SELECT l_orderkey, l_linenumber, l_extendedprice, position, least({LATE_PAGE}, pages) AS page, pages FROM n WHERE position > (least({LATE_PAGE}, pages) - 1) * 120 AND position <= least({LATE_PAGE}, pages) * 120""")
def late_page(spark, d):
    """A page far behind the first one: lines are numbered by ranges, and the page reads its ranges and places only."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return numbering.number(lines, [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], shared(spark, "numbered")).page(LATE_PAGE)


@query("""SELECT DISTINCT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 500 = 1 THEN 'changed' WHEN l_orderkey % 500 = 2 THEN 'removed' ELSE 'added' END AS change FROM (
  SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 500 IN (1, 2) UNION ALL SELECT -l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 500 = 3)""")
def changed_rows(spark, d):
    """Lines against a second version of them, with quantities and comments moved, lines gone and lines new."""
    first = table(spark, d, "lineitem")
    moved = F.col("l_orderkey") % 500 == 1
    second = first.where("l_orderkey % 500 <> 2").withColumn("l_quantity", F.when(moved, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    second = second.unionByName(first.where("l_orderkey % 500 = 3").withColumn("l_orderkey", -F.col("l_orderkey")))
    return checksums.changes(first, second, ["l_orderkey", "l_linenumber"])


SEARCHES = ("the of", "es src1", "en the and", "un")
SHOWN = 50


def _search_sql(text: str) -> str:
    words = text.split()
    inside = lambda column, word: f"contains(' ' || {column} || ' ', ' {word} ')"
    hits = [f"(len(list_filter(items, lambda x: {inside('x', w)})) > 0)" for w in words]
    every = " AND ".join(f"({h} OR {inside('meta', w)})" for h, w in zip(hits, words, strict=True))
    return f"""(SELECT '{text}' AS query, doc_id, n_items, priority, CAST(row_number() OVER (ORDER BY priority, n_items DESC, doc_id) AS INTEGER) AS place FROM (
  SELECT doc_id, {" + ".join(f"{h}::INT" for h in hits)} AS n_items, CASE WHEN title = '{text}' THEN 0 WHEN starts_with(title, '{text}') OR {inside("title", text)} THEN 1
    WHEN {" AND ".join(hits)} THEN 2 WHEN {" OR ".join(hits)} THEN 3 ELSE 4 END AS priority, {every} AS every FROM t) WHERE every OR priority < 2 QUALIFY place <= {SHOWN})"""


@query(f"""WITH t AS (SELECT doc_id, trim(regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-z0-9]+', ' ', 'g')) AS title, list_transform(string_split(text, '.'), lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))) AS items,
  trim(regexp_replace(lower(lang || ' ' || source || ' ' || text), '[^a-z0-9]+', ' ', 'g')) AS meta FROM documents) {" UNION ALL ".join(map(_search_sql, SEARCHES))}""")
def indexed_search(spark, d):
    """The best documents for some searches, by postings of all documents, equal to what rank gives."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    items = F.transform(F.split("text", r"\."), lambda x: F.struct(plain(x).alias("canonical"), F.array().cast("array<string>").alias("terms")))
    docs, folder = table(spark, d, "documents"), shared(spark, "index")
    index = postings.build(docs, "doc_id", [F.col("doc_id")], [plain(F.split("text", "\n")[0])], items, plain(F.concat_ws(" ", "lang", "source", "text")), folder)
    found = [index.search(search.parse_query(text.split(), {}, {}), SHOWN).select(F.lit(text).alias("query"), "doc_id", "n_items", "priority", "place") for text in SEARCHES]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


EVENT_SCHEMA = {
    "$schema": "https://json-schema.org/draft/2020-12/schema",
    "type": "object",
    "required": ["id", "type", "user", "value", "props"],
    "properties": {
        "type": {"type": "string", "enum": ["click", "view", "signup", "purchase"]},
        "value": {"type": "number", "minimum": 0, "maximum": 60},
        "user": {"type": "integer", "not": {"multipleOf": 7}},
        "props": {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "exclusiveMinimum": 20}}, "additionalProperties": False},
        "tags": {"type": "array", "uniqueItems": True, "maxItems": 2, "items": {"type": "string", "pattern": "^t[01]"}},
    },
    "if": {"properties": {"type": {"const": "purchase"}}},
    "then": {"properties": {"value": {"minimum": 10}}},
}


@query("""WITH e AS (SELECT event_id, event_type, value, user_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events)
SELECT event_id, '$.type' AS path, 'enum' AS keyword FROM e WHERE event_type = 'error' UNION ALL SELECT event_id, '$.value', 'maximum' FROM e WHERE value > 60
UNION ALL SELECT event_id, '$.value', 'minimum' FROM e WHERE event_type = 'purchase' AND value < 10 UNION ALL SELECT event_id, '$.user', 'not' FROM e WHERE user_id % 7 = 0
UNION ALL SELECT event_id, '$.props.k', 'exclusiveMinimum' FROM e WHERE k <= 20 UNION ALL SELECT event_id, '$.tags', 'uniqueItems' FROM e WHERE event_id % 3 = user_id % 3
UNION ALL SELECT event_id, '$.tags[0]', 'pattern' FROM e WHERE event_id % 3 = 2 UNION ALL SELECT event_id, '$.tags[1]', 'pattern' FROM e WHERE user_id % 3 = 2
UNION ALL SELECT event_id, '$.props', 'required' FROM e WHERE event_id % 1000 = 5 UNION ALL SELECT event_id, '$', 'json' FROM e WHERE event_id % 1000 = 7""".replace("FROM e WHERE", "FROM e WHERE event_id % 1000 <> 7 AND").replace("event_id % 1000 <> 7 AND event_id % 1000 = 7", "event_id % 1000 = 7").replace("event_id % 1000 <> 7 AND k <= 20", "event_id % 1000 NOT IN (5, 7) AND k <= 20"))  # fmt: skip
def schema_faults(spark, d):
    """Events as JSON texts, some without props and some cut off, against a schema with nested rules."""
    c = {k: F.col(k).cast("string") for k in ("event_id", "event_type", "user_id", "value", "props")}
    props = F.when(F.col("event_id") % 1000 == 5, "").otherwise(F.concat(F.lit(',"props":'), c["props"]))
    tag = lambda n: F.concat(F.lit('"t'), (F.col(n) % 3).cast("string"), F.lit('"'))
    text = F.concat(F.lit('{"id":'), c["event_id"], F.lit(',"type":"'), c["event_type"], F.lit('","user":'), c["user_id"], F.lit(',"value":'), c["value"], props, F.lit(',"tags":['), tag("event_id"), F.lit(","), tag("user_id"), F.lit("]"))
    text = F.when(F.col("event_id") % 1000 == 7, text).otherwise(F.concat(text, F.lit("}")))
    return json_schema.json_faults(table(spark, d, "events"), ["event_id"], text, EVENT_SCHEMA)


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS attempt, value > 95 AS done, event_type <> 'view' AS retry, CAST(props->>'$.k' AS INTEGER) AS k FROM events),
valid AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY attempt) = 1 OR retry AS ok FROM e),
ended AS (SELECT *, min(attempt) FILTER (ok AND done) OVER (PARTITION BY key) AS done_at FROM valid),
taken AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY attempt) AS n, count(*) OVER (PARTITION BY key) AS total FROM ended WHERE ok AND (done_at IS NULL OR attempt <= done_at)),
member AS (SELECT key, n, total, 'index' AS member, k % 3 > 0 AS bad FROM taken UNION ALL SELECT key, n, total, 'card-' || CAST(k % 2 AS VARCHAR), k % 5 > 0 FROM taken),
told AS (SELECT key, member, total, max(n) FILTER (n = total) AS here, bool_or(bad AND n = total) AS bad, list(n ORDER BY n) FILTER (bad) AS bads FROM member GROUP BY key, member, total)
SELECT key, NULL AS member, CASE WHEN max(done_at) IS NULL THEN 'failed' ELSE 'done' END AS status, CASE WHEN max(done_at) IS NULL THEN count(*) - 1 END::INTEGER AS retry_count,
  CASE WHEN max(done_at) IS NOT NULL AND count(*) = 1 THEN 0 ELSE count(*) END AS n_history FROM taken GROUP BY key
UNION ALL SELECT key, member, CASE WHEN bad THEN 'unsupported' ELSE 'done' END,
  CASE WHEN bad THEN (SELECT max(i) FROM range(1, total + 1) AS r(i) WHERE list_contains(bads, total - i + 1) AND len(list_filter(bads, lambda x: x > total - i)) = i) - 1 END::INTEGER, NULL FROM told WHERE here IS NOT NULL""")  # fmt: skip
def retry_counts(spark, d):
    """Events replayed as attempts at items, in three deliveries, two members each: what the keyed state holds in the end."""
    e, k = table(spark, d, "events"), F.get_json_object("props", "$.k").cast("int")
    rows = e.select(
        F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("attempt"),
        F.explode(F.array(
            F.struct(F.lit(None).cast("string").alias("member"), F.when(F.col("value") > 95, "done").otherwise("no layout").alias("outcome")),
            F.struct(F.lit("index").alias("member"), F.when(k % 3 > 0, "unsupported").otherwise("done").alias("outcome")),
            F.struct(F.concat(F.lit("card-"), (k % 2).cast("string")).alias("member"), F.when(k % 5 > 0, "unsupported").otherwise("done").alias("outcome")),
        )).alias("m"), (F.col("event_type") != "view").alias("retry"),
    ).select("key", "attempt", "m.member", "m.outcome", "retry")
    folder, last = shared(spark, "attempts"), e.agg(F.max("event_id")).first()[0] or 0
    for low in range(3):
        rows.where((F.col("attempt") * 3 >= low * (last + 1)) & (F.col("attempt") * 3 < (low + 1) * (last + 1))).write.mode("append").parquet(f"{folder}/in")
        attempts.follow(spark, f"{folder}/in", f"{folder}/mark", f"{folder}/changes")
    items, members, history = attempts.state(spark, f"{folder}/mark")
    items = items.join(history.groupBy("key").agg(F.count("*").alias("n_history")), "key", "left")
    items = items.select("key", F.lit(None).cast("string").alias("member"), "status", "retry_count", F.coalesce("n_history", F.lit(0)).alias("n_history"))
    return items.unionByName(members.select("key", "member", F.col("outcome").alias("status"), "retry_count", F.lit(None).cast("bigint").alias("n_history")))


@query("""WITH c AS (SELECT CAST(c_custkey % 16 AS INTEGER) AS bucket, c_custkey, c_custkey % 97 = 0 AND c_custkey % 16 <> 4 AS moved FROM customer), b AS (SELECT bucket, count(*) AS rows, bool_or(moved) AS moved FROM c GROUP BY bucket)
SELECT 'first' AS snapshot, bucket, rows, NOT moved AS shared, CASE WHEN bucket = 4 THEN 'altered' WHEN bucket = 9 AND NOT moved THEN 'missing' END AS fault FROM b
UNION ALL SELECT 'second', bucket, rows, NOT moved, CASE WHEN bucket = 4 THEN 'altered' WHEN bucket = 9 THEN 'missing' END FROM b""")
def snapshot_faults(spark, d):
    """Two snapshots of customers, of which one file was written over and another one deleted: what they share, and what the audit finds."""
    store, rows = shared(spark, "snapshots"), table(spark, d, "customer")
    moved = rows.withColumn("c_acctbal", F.when((F.col("c_custkey") % 97 == 0) & (F.col("c_custkey") % 16 != 4), F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    first, second = (snapshots.commit(x, store, ["c_custkey"], buckets=16, bucket=F.col("c_custkey") % 16) for x in (rows, moved))
    files = {r["bucket"]: r["files"][0] for r in snapshots.manifest(spark, store, second).where("kind = 'object'").collect()}
    for bucket, change in ((4, True), (9, False)):
        if bucket in files:
            at, fs = hadoop(spark, f"{store}/{files[bucket]['path']}")
            fs.delete(at, False)
            if change:
                out = fs.create(at, True)
                out.write(bytearray(b"x" * files[bucket]["size"]))
                out.close()
    parts = []
    for label, name, other in (("first", first, second), ("second", second, first)):
        found = snapshots.faults(spark, store, name).groupBy("bucket").agg(F.min("fault").alias("fault"))
        parts.append(snapshots.shared(spark, store, name, other).join(found, "bucket", "left").select(F.lit(label).alias("snapshot"), "bucket", "rows", "shared", "fault"))
    return parts[0].unionByName(parts[1])


@query(r"""WITH p AS (SELECT p_brand AS source, CAST(substr(p_brand, 7) AS INTEGER) AS n, p_type || '/' || replace(p_name, ' ', '/') || ['.md', '.json', '.txt'][CAST(p_partkey % 3 AS INTEGER) + 1] AS path FROM part)
SELECT DISTINCT source, path FROM p WHERE CASE WHEN n % 2 = 1 THEN starts_with(path, 'ECONOMY/') OR regexp_matches(path, '^PROMO/r.d/') ELSE ends_with(path, '.md') OR regexp_matches(path, '/[a-m].*\.json$') END
AND NOT contains(path, '/small/') AND NOT (n % 5 = 0 AND ends_with(path, '.txt'))""")
def selected_paths(spark, d):
    """Paths by their sources' include and exclude patterns, both made from parts."""
    parts, n = table(spark, d, "part"), F.substring("p_brand", 7, 9).cast("int")
    path = F.concat("p_type", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.when(F.col("p_partkey") % 3 == 0, ".md").when(F.col("p_partkey") % 3 == 1, ".json").otherwise(".txt"))
    rule = lambda kind, pattern, ok=None: F.when(F.lit(True) if ok is None else ok, F.struct(F.lit(kind).alias("kind"), F.lit(pattern).alias("pattern")))
    rules = F.array(
        rule("include", "ECONOMY/*", n % 2 == 1), rule("include", "PROMO/r?d/*", n % 2 == 1), rule("include", "*.md", n % 2 == 0), rule("include", "*/[a-m]*.json", n % 2 == 0),
        rule("exclude", "*/small/*"), rule("exclude", "*.txt", n % 5 == 0),
    )
    table_of = parts.select(F.col("p_brand").alias("source"), F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r")).select("source", "r.kind", "r.pattern")
    return patterns.selected(parts.select(F.col("p_brand").alias("source"), path.alias("path")), table_of)


@query("""WITH o AS (SELECT o_orderpriority AS source, o_orderstatus AS status, CAST(year(o_orderdate) AS VARCHAR) AS year, o_custkey FROM orders)
SELECT source, grouping(source) = 1 AS is_total, CASE WHEN grouping(status) = 0 THEN 'status' WHEN grouping(year) = 0 THEN 'year' END AS dimension, CASE WHEN grouping(status) = 0 THEN status WHEN grouping(year) = 0 THEN year END AS value,
  count(*) AS n, max(o_custkey) AS last_customer FROM o GROUP BY GROUPING SETS ((source, status), (source, year), (status), (year), (source), ())""")
def source_histograms(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("status"), F.year("o_orderdate").cast("string").alias("year"), "o_custkey")
    return reports.histograms(rows, "source", ["status", "year"], {"last_customer": F.max("o_custkey")})


@query("""SELECT o_orderstatus AS status, count(*) AS n, count(*) FILTER (o_orderkey % 3 = 1 AND o_orderkey % 10 = 1) AS without_customer, sum(o_orderkey)::BIGINT AS keys, max(CASE WHEN o_orderkey % 3 = 1 AND o_orderkey % 10 = 1 THEN NULL ELSE o_custkey END) AS last_customer
FROM orders WHERE NOT (o_orderkey % 3 = 1 AND o_orderkey % 10 = 2) GROUP BY o_orderstatus""")
def kept_audit(spark, d):
    """Orders in two deliveries, then one delivery's files replaced by others, some customers and orders fewer: the audit as it was kept up to date."""
    rows, folder = table(spark, d, "orders"), shared(spark, "audit")
    audit = reports.Audit(spark, f"{folder}/in", f"{folder}/state", {"status": F.col("o_orderstatus")}, {"without_customer": F.col("o_custkey").isNull().cast("int"), "keys": F.col("o_orderkey")}, highs={"last_customer": F.col("o_custkey")})

    def deliver(part: int, some) -> None:
        some.where(F.col("o_orderkey") % 3 == part).write.mode("overwrite").parquet(f"{folder}/in/{part}")

    deliver(0, rows), deliver(1, rows)
    audit.update(1)
    deliver(2, rows)
    audit.update(2)
    deliver(1, rows.where("o_orderkey % 10 <> 2").withColumn("o_custkey", F.when(F.col("o_orderkey") % 10 != 1, F.col("o_custkey"))))
    audit.update(3)
    return audit.result()


@query("""SELECT l_returnflag, count(*) AS n, array_to_string(list_sort(list(DISTINCT l_suppkey))[1:3], ',') AS evidence, array_to_string(list_sort(list(DISTINCT l_partkey))[1:30], ',') AS examples FROM lineitem GROUP BY l_returnflag""")
def first_examples(spark, d):
    """A few hot groups, the first 3 suppliers and 30 parts of each: no task ever holds more of a group than these."""
    out = reports.first_values(table(spark, d, "lineitem"), ["l_returnflag"], {"evidence": ("l_suppkey", 3), "examples": ("l_partkey", 30)})
    return out.select("l_returnflag", "n", *(F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("evidence", "examples")))


@query("""SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CAST(floor((row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1) / 200) AS BIGINT) AS chunk FROM lineitem""")
def hot_chunks(spark, d):
    """A few groups of all lines, cut into chunks of 200 without sorting any group in one task."""
    by = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    rows = table(spark, d, "lineitem").select("l_returnflag", *by)
    return numbering.chunks(rows, 200, ["l_returnflag"], [F.col(c) for c in by], shared(spark, "chunks"))


@query("SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1) % 7 AS INTEGER) AS bin FROM orders")
def dealt_bins(spark, d):
    """All orders dealt over seven bins, dearest first: a global order, in no single task."""
    return numbering.dealt(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 7, [F.desc("o_totalprice"), F.col("o_orderkey")], shared(spark, "dealt")).drop("o_totalprice")
