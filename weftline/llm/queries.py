"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, decontaminate, fill_in_middle, jaccard_join, language_id, license_scan, maxent_lm, quality_rules, token_counts, toxicity, url_filters, vector_codes
from .common import held_out, table, written

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(*toxicity.training_sample(docs, table(spark, sf_dir, "labels"), ~held_out(5)))
    out = toxicity.score(docs, model, keep=["doc_id"])
    return out.select("doc_id", held_out(5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: Dated changes of the list: key, category, day, action.
URL_LIST = (
    ("cheap-pills.example.com", "pharma", "2024-01-01", "add"),
    ("cheap-pills.example.com", "pharma", "2024-05-15", "remove"),
    ("cheap-pills.example.com", "pharma", "2024-09-01", "add"),
    ("casino-win.example.org", "gambling", "2024-03-01", "add"),
    ("adult-x.example.net", "adult", "2024-01-01", "add"),
    ("adult-x.example.net", "adult", "2024-11-01", "remove"),
    ("tionsh.example.net", "spam", "2024-06-01", "add"),
    ("blog.tionsh.example.net", "blog", "2024-02-01", "add"),
    ("blog.tionsh.example.net", "blog", "2024-04-01", "remove"),
    ("example.org", "reviewed", "2024-07-01", "add"),
    ("example.org", "reviewed", "2024-08-01", "remove"),
    ("m.adult-x.example.net/en", "language", "2024-01-10", "add"),
)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages has no fetch time; page_id gives each capture a day of 2024."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")).alias("fetched"))
    changes = spark.createDataFrame(list(URL_LIST), "key string, category string, day string, action string").withColumn("day", F.col("day").cast("date"))
    out = url_filters.filter_urls(pages, changes)
    return out.select("page_id", F.array_join("matched_keys", ",").alias("matched_keys"), F.array_join("categories", ",").alias("categories"), "blocked")


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    base, method = F.transform("phrases", lambda x: x["label"]), F.transform("matches", lambda x: x["label"])
    places = F.transform("phrases", lambda x: x["word"])
    best = F.when(F.size("phrases") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("matches", lambda x: x["containment"])), F.lit(0.0)))
    return out.select(
        "doc_id", "n_words", F.size("phrases").cast("bigint").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat(base, method))), ",").alias("labels"), F.round(best, 6).alias("score"),
    )


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text").unionByName(extra)
    out = chat_format.read_back(chat_format.format_chat(turns))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"), "valid",
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), keep=["doc_id"])


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), limit=1024, keep=["doc_id"])


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    hit = F.aggregate("removal_spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end_word"] - x["first_word"])
    out = out.select("doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score_lm(table(spark, sf_dir, "documents").select("doc_id", "text"), ~held_out(10))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *quality_rules.MEASURES, "base_failed", "kept")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("fim")).alias("output_sha256"), digest(fill_in_middle.restored("fim", "form")).alias("restored_sha256"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), held_out(4, 2)
    model = language_id.learn(docs, ~out)
    return language_id.identify(docs.select("doc_id", "text"), model, keep=["doc_id"]).select("doc_id", out.alias("held_out"), "lang_pred", "score", "margin")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = vector_codes.learn(vectors)
    out = vector_codes.with_totals(written(vector_codes.encode(vectors, books, keep=["vec_id", "label"]), "codes"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else None).alias("codebooks_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_url_filters, op3_license_scans, op4_chat_format, op5_bpe, op6_token_counts, op7_decontamination, op8_lm_scoring, op9_quality_rules, op10_jaccard_join, op11_fill_in_middle, op12_language_id, op13_vector_codes, pipeline)}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_INK = "[^\\x20\\x09-\\x0D]"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + str(x) + "'" for x in row) + ")" for row in rows)


OP2_SQL = f"""
WITH change AS (SELECT key, category, CAST(day AS DATE) AS day, action FROM (VALUES {_values(URL_LIST)}) AS v(key, category, day, action)),
span AS (SELECT key, category, day AS valid_from, action, lead(day) OVER (PARTITION BY key, category ORDER BY day) AS valid_to FROM change),
capture AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]+/([^?#]*)', 1) AS path,
  CAST('2024-01-01' AS DATE) + CAST(page_id % 366 AS INTEGER) AS fetched FROM pages),
hit AS (SELECT page_id, key, category FROM capture JOIN span ON action = 'add' AND valid_from <= fetched AND (valid_to IS NULL OR fetched < valid_to)
  AND (host = key OR ends_with(host, '.' || key) OR (contains(key, '/') AND starts_with(host || '/' || path || '/', key || '/'))))
SELECT page_id, coalesce(string_agg(DISTINCT key, ',' ORDER BY key), '') AS matched_keys, coalesce(string_agg(DISTINCT category, ',' ORDER BY category), '') AS categories, count(key) > 0 AS blocked
FROM capture LEFT JOIN hit USING (page_id) GROUP BY page_id
"""

OP3_SQL = f"""
WITH phrase AS (SELECT phrase, label FROM (VALUES {_values(license_scan.PHRASES)}) AS v(phrase, label)),
template AS (SELECT row_number() OVER () AS template, list_distinct(string_split(text, ' ')) AS t, CAST(ceil(len(string_split(text, ' ')) / {license_scan.THRESHOLD} - 1e-9) AS BIGINT) AS width, label FROM (VALUES {_values(license_scan.TEMPLATES)}) AS v(text, label)),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
place AS (SELECT doc_id, label, p - 1 AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM doc) CROSS JOIN phrase
  WHERE w[p] = string_split(phrase, ' ')[1] AND w[p : p + len(string_split(phrase, ' ')) - 1] = string_split(phrase, ' ')),
spot AS (SELECT doc_id, w, p, template FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM doc) JOIN (SELECT template, unnest(t) AS x FROM template) AS v ON v.x = w[p]),
block AS (SELECT doc_id, label, t, len(list_intersect(t, list_distinct(w[p : p + width - 1]))) AS n FROM spot JOIN template USING (template)),
found AS (SELECT doc_id, label, n / len(t) AS c FROM block WHERE n >= ceil({license_scan.THRESHOLD} * len(t) - 1e-9)),
base AS (SELECT doc_id, count(*) AS n, min(word) AS a, max(word) AS b, list(DISTINCT label) AS l FROM place GROUP BY doc_id),
method AS (SELECT doc_id, max(c) AS c, list(DISTINCT label) AS l FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(b AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(base.l), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(coalesce(base.l, []) || coalesce(method.l, []))), ','), '') AS labels,
  round(CASE WHEN n > 0 THEN 1.0 ELSE coalesce(c, 0.0) END, 6) AS score
FROM doc LEFT JOIN base USING (doc_id) LEFT JOIN method USING (doc_id)
"""

_ESCAPED = "replace(replace(replace({0}, '\\', '\\b'), '###', '\\h'), '</turn>', '\\e')"
OP4_SQL = f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
steps AS (SELECT *, coalesce(lag(role) OVER w, 'start') || '>' || role AS step, lead(role) OVER w IS NULL AND role <> 'assistant' AS bad_end FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(replace({_ESCAPED.format("role")}, ':', '\\c')) + 2 + length({_ESCAPED.format("text")}) + 8) AS BIGINT) AS formatted_chars,
  bool_and(step IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user')) AND NOT bool_or(bad_end) AS valid
FROM steps GROUP BY conv_id
"""

OP7_SQL = f"""
WITH doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, w, least(10, len(w)) AS size FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)),
phrase AS (SELECT DISTINCT item_id, size, array_to_string(w[p : p + size - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS p FROM item WHERE size > 0)),
spot AS (SELECT doc_id, size, p, array_to_string(w[p : p + size - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM doc CROSS JOIN (SELECT DISTINCT size FROM phrase) WHERE len(w) >= size)),
hit AS (SELECT doc_id, item_id, p, size FROM spot JOIN phrase USING (size, phrase)),
word AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS listed FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP9_SQL = f"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_INK}+') AS w FROM documents),
tri AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p], w[p + 1], w[p + 2]) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM doc WHERE len(w) >= 3)),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM tri WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM doc) WHERE regexp_matches(l, '{_INK}') GROUP BY doc_id),
top_word AS (SELECT doc_id, max(c) AS n FROM (SELECT doc_id, count(*) AS c FROM (SELECT doc_id, unnest(w) AS x FROM doc) GROUP BY doc_id, x) GROUP BY doc_id),
top_pair AS (SELECT doc_id, max(c) AS n FROM (SELECT doc_id, count(*) AS c FROM (SELECT doc_id, unnest(list_zip(w[1 : len(w) - 1], w[2 : len(w)])) AS x FROM doc WHERE len(w) >= 2) GROUP BY doc_id, x) GROUP BY doc_id),
measured AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  coalesce(top_word.n, 0) AS n_top_word, coalesce(top_pair.n, 0) AS n_top_pair FROM doc LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN top_word USING (doc_id) LEFT JOIN top_pair USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 5 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 40 * n_words OR 2 * n_dup_lines > n_words
    OR 100 * n_top_word > 30 * n_words OR 200 * n_top_pair > 20 * n_words) AS kept
FROM measured
"""

OP10_SQL = f"""
WITH RECURSIVE doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
shingle AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingle AS a JOIN shingle AS b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN size AS x ON x.doc_id = a JOIN size AS y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
classes AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a),
links AS (SELECT a AS doc_id, count(*) AS n FROM link GROUP BY a)
SELECT doc_id, class_id, coalesce(n, 0) AS n_links FROM classes LEFT JOIN links USING (doc_id)
"""

OP11_SQL = """
WITH doc AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
drawn AS (SELECT *, CAST(len(w) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM doc),
cut AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
part AS (SELECT *, array_to_string(w[1 : a], '') AS p, array_to_string(w[a + 1 : b], '') AS m, array_to_string(w[b + 1 : n], '') AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM part
"""



def _round(k: int) -> str:
    """Assignment to the codebooks book{k}, and the next ones."""
    return f"""
near{k} AS MATERIALIZED (SELECT vec_id, p, x, m % 256 AS k, m // 256 AS d FROM (SELECT vec_id, p, any_value(x) AS x, min(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) * 256 + k) AS m
  FROM part JOIN book{k} USING (p) GROUP BY vec_id, p)),
mean{k} AS (SELECT p, k, list((s - (s % n + n) % n) // n ORDER BY i) AS c FROM (SELECT p, k, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM near{k}, unnest(range(1, len(x) + 1)) AS v(i) GROUP BY p, k, i) GROUP BY p, k),
book{k + 1} AS MATERIALIZED (SELECT p, k, coalesce(mean{k}.c, book{k}.c) AS c FROM book{k} LEFT JOIN mean{k} USING (p, k)),"""


OP13_SQL = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM kept, unnest(range(16)) AS u(p)),
book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, x AS c FROM part WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
{_round(0)}{_round(1)}{_round(2)}
done AS (SELECT vec_id, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near2 GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, k, i)) AS codebooks_sha256 FROM (SELECT p, k, i, c[i] AS y FROM book2, unnest(range(1, len(c) + 1)) AS v(i)))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM done JOIN kept USING (vec_id) CROSS JOIN digest
"""

ORACLE_SQL = {"op2_url_filters": OP2_SQL, "op3_license_scans": OP3_SQL, "op4_chat_format": OP4_SQL, "op7_decontamination": OP7_SQL, "op9_quality_rules": OP9_SQL, "op10_jaccard_join": OP10_SQL, "op11_fill_in_middle": OP11_SQL, "op13_vector_codes": OP13_SQL}
