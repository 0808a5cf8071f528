"""A static site of records: pages, an index in catalog order, checks. Pages are rows; only writing them touches files.

The catalog's order is total, so the same records give the same bytes whatever the partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import casefold, display_title, html_escape, page_url, visible_text
from ..functions.workers import ready

# Units that must not be shown.
FORBIDDEN = r"(?i)\b(?:tsp|tbsp|teaspoons?|tablespoons?)\b"
FACETS = {"cuisines": "Cuisine", "meal_types": "Type", "proteins": "Protein", "methods": "Method", "times": "Time"}


def _joined(parts: Column) -> Column:
    return F.array_join(parts, "")


def _tag(name: str, inner: Column, attrs: str = "") -> Column:
    return F.concat(F.lit(f"<{name}{' ' if attrs else ''}{attrs}>"), inner, F.lit(f"</{name}>"))


def _link(href: Column, inner: Column, more: str = "") -> Column:
    return F.concat(F.lit('<a href="'), html_escape(href), F.lit(f'"{more}>'), inner, F.lit("</a>"))


_OUTWARD = ' class="source-link" target="_blank" rel="noopener noreferrer"'


def page(title: Column, body: Column) -> Column:
    return F.concat(F.lit('<!doctype html><html><head><meta charset="utf-8"><title>'), html_escape(title), F.lit("</title></head><body>"), body, F.lit("</body></html>"))


def index_entries(records: DataFrame) -> DataFrame:
    """What the index shows of records (id, title, score, source_url, facts and the arrays of FACETS): no score, no steps, in no order yet."""
    ready(records.sparkSession)
    title = display_title(F.col("title"))
    return records.select(
        "id", page_url(F.col("id")).alias("url"), title.alias("title"), casefold(title).alias("sort_title"), "source_url", "facts", *FACETS,
        F.coalesce("score", F.lit(0.0)).alias("_score"), casefold(F.coalesce("title", F.lit(""))).alias("_title"),
    )


def catalog_order() -> list[Column]:
    """Score (none counts as 0), then title without case, then id; over index_entries."""
    return [F.desc("_score"), F.col("_title"), F.col("id")]


def card(title: Column, url: Column, source_url: Column, facts: Column, identifier: Column) -> Column:
    """A line of the index."""
    out = F.when(F.coalesce(source_url, F.lit("")) != "", _link(source_url, F.lit("↗"), _OUTWARD)).otherwise(F.lit(""))
    meta = F.when(F.coalesce(facts, F.lit("")) != "", _tag("p", html_escape(facts), 'class="row-meta"')).otherwise(F.lit(""))
    return F.concat(F.lit('<article class="recipe-row" data-recipe-id="'), html_escape(identifier), F.lit('">'), _tag("h2", F.concat(_link(url, html_escape(title)), out)), meta, F.lit("</article>"))


def detail_pages(records: DataFrame) -> DataFrame:
    """(id, url, html, forbidden) for each record (as for index_entries, with items, steps, attribution, license)."""
    title = display_title(F.col("title"))
    listed = lambda c, kind: _tag(kind, _joined(F.transform(c, lambda x: _tag("li", html_escape(x)))))
    has_source = F.coalesce(F.col("source_url"), F.lit("")) != ""
    steps = F.coalesce(F.col("steps"), F.array().cast("array<string>"))
    method = F.when(F.size(steps) > 0, listed(steps, "ol")).when(has_source, F.lit("<p>Cooking instructions are available in the original recipe.</p>")).otherwise(F.lit(""))
    body = F.concat(
        F.lit('<article><a href="../index.html">← Back</a>'), _tag("h1", html_escape(title)), _tag("p", html_escape(F.coalesce("facts", F.lit("")))),
        _tag("section", F.concat(F.lit("<h2>Ingredients</h2>"), listed(F.coalesce("items", F.array().cast("array<string>")), "ul"))),
        _tag("section", F.concat(F.lit("<h2>Instructions</h2>"), method, F.when(has_source, _link(F.col("source_url"), F.lit("View original recipe ↗"), _OUTWARD)).otherwise(F.lit("")))),
        _tag("section", F.concat(F.lit("<h2>Source</h2>"), _tag("p", html_escape(F.coalesce("attribution", F.lit("")))), _tag("p", html_escape(F.coalesce("license", F.lit("License unknown")))))), F.lit("</article>"),
    )
    pages = records.select("id", page_url(F.col("id")).alias("url"), page(title, body).alias("html"))
    return pages.withColumn("forbidden", visible_text(F.col("html")).rlike(FORBIDDEN))


def membership(entries: DataFrame) -> DataFrame:
    """(axis, label, id) for every label of every facet."""

    def labelled(axis: str) -> Column:
        return F.transform(axis, lambda x: F.struct(F.lit(axis).alias("axis"), x.alias("label")))

    pairs = F.flatten(F.array(*map(labelled, FACETS)))
    return entries.select("id", F.explode(pairs).alias("p")).select("p.axis", "p.label", "id")


def manifest(entries: DataFrame) -> DataFrame:
    """One row: records, records without a source, and the number of labels on each axis."""
    labels = [F.size(F.array_distinct(F.flatten(F.collect_set(c)))).alias(f"n_{c}") for c in FACETS]
    return entries.agg(F.count("*").alias("records"), F.count_if(F.coalesce("source_url", F.lit("")) == "").alias("missing_source_urls"), *labels)


def write_site(records: DataFrame, folder: str) -> int:
    """Writes detail pages and the index below folder and returns the number of pages. Forbidden units stop it before anything is written.

    Files are made by the tasks through Hadoop's file system, each under its final name after a rename, so folder may
    be any store that Spark writes, and a task that runs again replaces its own files. The index is one text, made of
    lines sorted by Spark; its size is that of all titles."""
    spark = records.sparkSession
    pages = detail_pages(records)
    bad = [r["id"] for r in pages.where("forbidden").select("id").orderBy("id").limit(5).collect()]
    if bad:
        raise ValueError(f"forbidden units in {bad}")
    write_files(pages.select("url", "html"), folder)
    entries = index_entries(records)
    n = entries.count()
    cards = entries.orderBy(*catalog_order()).select(card(F.col("title"), F.col("url"), F.col("source_url"), F.col("facts"), F.col("id")).alias("value"))
    head = f'<!doctype html><html><head><meta charset="utf-8"><title>Records</title></head><body><p role="status">{n:,} records</p><section id="catalog-results">\n'
    out = _create(spark, f"{folder}/index.html")
    out.write(bytearray(head.encode()))
    for row in cards.toLocalIterator():
        out.write(bytearray((row["value"] + "\n").encode()))
    out.write(bytearray(b"</section></body></html>"))
    out.close()
    _replace(spark, f"{folder}/index.html")
    return n + 1


def _fs(spark, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _create(spark, path: str):
    p, fs = _fs(spark, path + ".part")
    return fs.create(p, True)


def _replace(spark, path: str) -> None:
    """The finished part takes the name of what was there, in one step: readers see the old file or the new one."""
    _renamed(spark, path + ".part", path)


def _renamed(spark, part: str, final: str) -> None:
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_fs(spark, part)[0].toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(_fs(spark, part)[0], _fs(spark, final)[0], options)


def write_files(files: DataFrame, folder: str) -> None:
    """One file for each row (url, html). The part after the last slash must be a file name; Spark's text sink writes each in a task."""
    spark = files.sparkSession
    staged = f"{folder}/_staged"
    files.select(F.col("html").alias("value"), F.col("url")).repartition("url").write.mode("overwrite").partitionBy("url").text(staged)
    root, fs = _fs(spark, staged)
    moved = fs.listStatus(root)
    for s in moved:
        name = spark._jvm.java.net.URLDecoder.decode(s.getPath().getName(), "UTF-8").removeprefix("url=")
        for part in fs.listStatus(s.getPath()) if s.isDirectory() else ():
            if part.getPath().getName().startswith("part-"):
                target, _ = _fs(spark, f"{folder}/{name}")
                fs.mkdirs(target.getParent())
                _renamed(spark, part.getPath().toString(), target.toString())
    fs.delete(root, True)
