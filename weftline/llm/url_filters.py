"""URL filters as a temporal list join.

List entries are dated changes (key, category, day, action): from an "add" on, the key is on the list, from
a "remove" on it is not. They become validity intervals, and every capture is judged by an as-of join
against the entries active when it was fetched. A key is a host or a parent domain, and matches all hosts
below it, or a host with a leading path ("a.example/x"), which matches that path and what is below it.

A capture has one candidate key for each domain and path prefix of its URL, as far down as the list's keys
go. Intervals of a key are disjoint, so a candidate meets at most one active interval of a category. Captures
and list meet by an equi-join on the key. If the list's size, counted first, is at most BROADCAST_ROWS, it is
broadcast; otherwise the list meets distinct (key, day) pairs, and their outcome goes back to the captures' keys by a
join that cuts hot keys (a host or parent domain with many captures on a day) into pieces. So does the join of captures
with the outcome of their (URL, day), as one URL may hold a large part of a day's captures.

Cases: a null or malformed URL, or a null fetch day, matches nothing; repeated changes and an add of a key
that is on the list already change nothing; a "remove" on the same day as an "add" comes after it; repeated
captures are judged alike; upper case in a key's host is folded and a final dot of it dropped, also in matched_keys; captures' other columns
pass through, one with an output's name is replaced; an empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, fresh, ready, spread_join, written

BROADCAST_ROWS = 100_000


def validity_intervals(changes: DataFrame) -> DataFrame:
    """(key, category, valid_from, valid_to) with valid_to exclusive, null while the key stays on the list."""
    w = Window.partitionBy("key", "category").orderBy("day", "off")
    # A key's own changes only; a list dates a key a handful of times.
    host = F.substring_index("key", "/", 1)
    changes = changes.withColumn("key", F.concat(F.regexp_replace(F.lower(host), r"\.$", ""), F.substr("key", F.length(host) + 1)))
    rows = changes.where("key is not null and category is not null and day is not null").select("key", "category", "day", (F.col("action") == "remove").alias("off")).distinct()
    turns = rows.withColumn("before", F.lag("off", 1, True).over(w)).where("off <> before")
    return turns.withColumn("valid_to", F.lead("day").over(w)).where("not off").select("key", "category", F.col("day").alias("valid_from"), "valid_to").where("valid_to is null or valid_from < valid_to")


def url_host(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^https?://(?:[^/?#@]*@)?([^/:?#@]+)", 1)


def url_keys(url: Column, labels_deep: int, path_deep: int) -> Column:
    """The host, its parent domains of 1 to labels_deep labels, and the host with the first 1 to path_deep parts of the path."""
    host = F.regexp_replace(url_host(url), r"\.$", "")
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size(labels), F.lit(labels_deep)))), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    path = F.filter(F.split(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+/([^?#]*)", 1), "/"), lambda x: x != "")
    paths = F.transform(F.filter(F.sequence(F.lit(1), F.lit(max(1, path_deep))), lambda n: n <= F.size(path)), lambda n: F.concat_ws("/", host, F.array_join(F.slice(path, F.lit(1), n), "/")))
    return F.when(F.coalesce(host, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, F.array(host), paths)))


def filter_urls(captures: DataFrame, changes: DataFrame, url_col: str = "url", day_col: str = "fetched", id_col: str = "page_id") -> DataFrame:
    """captures with matched_keys and categories (sorted arrays of the active entries) and blocked."""
    added = ("matched_keys", "categories", "blocked")
    ready(captures.sparkSession)
    base = captures.drop(*added)
    # A URL's keys and a day decide the outcome, so each distinct (URL, day) is judged once.
    urls = base.select(F.col(url_col).alias("u"), F.col(day_col).alias("d")).where("u is not null and d is not null").groupBy("u", "d").agg(F.count("*").alias("captures"))
    intervals = validity_intervals(changes)
    # One row: how long the list is, and how deep its keys go.
    listed, labels_deep, path_deep = intervals.agg(F.count("*"), F.max(F.size(F.split(F.substring_index("key", "/", 1), r"\."))), F.max(F.size(F.split("key", "/")) - 1)).first()
    keyed = urls.withColumn("key", F.explode(url_keys(F.col("u"), labels_deep or 0, path_deep or 0)))
    small = listed <= BROADCAST_ROWS
    active = (F.col("d") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("d") < F.col("valid_to")))
    if small:
        found = keyed.join(F.broadcast(intervals), "key").where(active).select("u", "d", "captures", "key", "category")
    else:
        days = written(keyed.groupBy("key", "d").agg(F.count("*").alias("n")), "days")
        total = days.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        hit = days.join(intervals, "key").where(active).groupBy("key", "d").agg(F.collect_set("category").alias("some"), F.first("n").alias("n"))
        found = written(spread_join(keyed, hit, ["key", "d"], "n", total).select("u", "d", "captures", "key", F.explode("some").alias("category")), "hits")
        dropped(captures.sparkSession, days)
    hits = found.groupBy("u", "d", "captures").agg(F.sort_array(F.collect_set("key")).alias("matched_keys"), F.sort_array(F.collect_set("category")).alias("categories"))
    # Captures get numbers, as equal ones of a hot URL must still be dealt over its pieces.
    mark = fresh("_mark", base.columns)
    names = {"u": url_col, "d": day_col}
    out = spread_join(base.withColumn(mark, F.monotonically_increasing_id()), hits.withColumnsRenamed(names), [url_col, day_col], "captures", base.count(), "left", urls.withColumnsRenamed(names), mark)
    empty = F.array().cast("array<string>")
    return out.select(*base.columns, F.coalesce("matched_keys", empty).alias("matched_keys"), F.coalesce("categories", empty).alias("categories"), F.col("matched_keys").isNotNull().alias("blocked"))
