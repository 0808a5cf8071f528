"""Stable identifiers and content fingerprints as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_text(value: Column) -> Column:
    """A string as JSON text, non-ASCII kept, null as null."""
    quoted = F.to_json(F.array(value))
    return F.when(value.isNull(), F.lit("null")).otherwise(F.substr(quoted, F.lit(2), F.length(quoted) - 2))


def json_array(items: Column) -> Column:
    """An array of JSON texts as one JSON array with ", " between its items."""
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def stable_id(*parts: Column) -> Column:
    """The first 24 hex digits of the SHA-256 of the parts (strings) as a JSON array."""
    return F.substring(F.sha2(json_array(F.array(*(json_text(p) for p in parts))).cast("binary"), 256), 1, 24)


def content_fingerprint(title: Column, group: Column, items: Column, steps: Column) -> Column:
    """Equal for records with the same title, group, multiset of items (structs of values; order is irrelevant) and sequence of steps."""
    flat = F.array_sort(F.transform(items, lambda x: F.to_json(x)))
    return F.substring(F.sha2(json_array(F.array(json_text(title), json_text(group), json_array(flat), json_array(F.transform(steps, json_text)))).cast("binary"), 256), 1, 24)


def combined_fingerprint(*hashes: Column) -> Column:
    """A hash of hashes: inputs that many rows share are hashed once, not with every row."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(h, F.lit("-")) for h in hashes)), 256)
