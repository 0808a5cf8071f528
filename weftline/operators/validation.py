"""Audits of finished tables: each returns (check, key) rows for what is wrong, none where all is right."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_escape
from .site import FORBIDDEN
from .tables import orphans, same_rows


def _named(check: str, rows: DataFrame, key: Column) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), key.cast("string").alias("key"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def pipeline_faults(raw: DataFrame, normalized: DataFrame, matches: DataFrame, items: DataFrame, events_failed: DataFrame, discovered: DataFrame) -> DataFrame:
    """Provenance (every normalized record has a raw one and a source), references (every match a normalized record, and
    one match each), accounting (every discovered file processed or failed, and not both), ownership (an id in one file)."""
    key = F.col("key")
    return _all([
        _named("normalized without raw", orphans(normalized.select(F.col("raw_id").alias("id")), raw, "id"), F.col("id")),
        _named("raw without provenance", raw.where("source is null or path is null"), F.col("id")),
        _named("match without record", orphans(matches.select("id"), normalized, "id"), F.col("id")),
        _named("record without match", orphans(normalized.select("id"), matches, "id"), F.col("id")),
        _named("several matches", matches.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), F.col("id")),
        _named("id in several files", raw.groupBy("id").agg(F.count_distinct("key").alias("n")).where("n > 1"), F.col("id")),
        _named("unaccounted file", discovered.select("key").distinct().join(items.select("key").unionByName(events_failed.select("key")).distinct(), "key", "left_anti"), key),
        _named("processed and failed", items.select("key").join(events_failed.select("key").distinct(), "key", "left_semi"), key),
    ])


def rerun_faults(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows that a repeated run didn't give again, or gave anew."""
    return _named("not reproducible", same_rows(first, second), F.col(key))


def forbidden_units(rows: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """Rows of which one of the columns (strings or arrays of strings) still shows a kitchen unit."""
    kinds = {c: rows.schema[c].dataType.typeName() for c in texts}
    shown = [F.array_join(c, "\n") if kinds[c] == "array" else F.col(c) for c in texts]
    return _named("forbidden unit", rows.where(F.concat_ws("\n", *shown).rlike(FORBIDDEN)), F.col(key))


def catalog_faults(entries: DataFrame, pages: DataFrame, records: DataFrame) -> DataFrame:
    """entries of the index against records (id, representative, steps) and detail pages (id, url, html, forbidden)."""
    wanted = records.where("id = representative")
    both = records.select("id", "steps").join(pages, "id").withColumn("step", F.explode("steps"))
    return _all([
        _named("record missing from the index", orphans(wanted.select("id"), entries, "id"), F.col("id")),
        _named("index entry without record", orphans(entries.select("id"), wanted, "id"), F.col("id")),
        _named("several entries", entries.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), F.col("id")),
        _named("entry without page", orphans(entries.select("url"), pages, "url"), F.col("url")),
        _named("forbidden unit on a page", pages.where("forbidden"), F.col("id")),
        _named("page without sections", pages.where(~(F.contains("html", F.lit("<h2>Ingredients</h2>")) & F.contains("html", F.lit("<h2>Instructions</h2>")))), F.col("id")),
        _named("step missing from a page", both.where(~F.contains("html", html_escape(F.col("step")))).select("id").distinct(), F.col("id")),
    ])


def evidence_faults(products: DataFrame, items: DataFrame, product_id_of) -> DataFrame:
    """products (product_id, source_url, status, availability, store_id, retrieved_at) must be likely and nothing more, and
    items (item, product_ids, n_evidence, status) must name products that are there."""
    named = items.select("item", F.explode("product_ids").alias("product_id"))
    likely = F.coalesce(F.col("status") == "likely_available", F.lit(False))
    return _all([
        _named("product of another URL", products.where(~F.coalesce(product_id_of(F.col("source_url")) == F.col("product_id"), F.lit(False))), F.col("product_id")),
        _named("product says too much", products.where(~likely | F.col("availability").isNotNull() | F.col("store_id").isNotNull() | F.col("retrieved_at").isNull()), F.col("product_id")),
        _named("item without evidence", items.where(~likely | (F.size("product_ids") <= 0) | ~F.coalesce(F.col("n_evidence") > 0, F.lit(False))), F.col("item")),
        _named("item of an unknown product", orphans(named, products, "product_id"), F.col("item")),
    ])


def file_counts(rows: DataFrame) -> DataFrame:
    """(file, n): records of each input file."""
    return rows.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"))
