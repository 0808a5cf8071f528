"""Selection of paths by patterns that are rows: includes and excludes of each source come from a table of any size.

A pattern has a key that every path it matches has too: the folders before its first wildcard, else the extension behind its
last one. Paths meet patterns by an equi-join on source and key, a path having one key for each of its folders and one for
its extension; only pairs that meet are matched in full. A pattern without either, such as "*a*", meets all paths of its source.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import glob_regex
from ..functions.workers import ready

_WILD = r"[*?\[]"


@F.pandas_udf(T.StringType())
def _regex(patterns: pd.Series) -> pd.Series:
    return patterns.map(glob_regex)


def pattern_key(pattern: Column) -> Column:
    """"d:" and the folders before the first wildcard; "e:" and the extension behind the last; else "". A pattern without wildcards has its folders."""
    literal = F.regexp_extract(pattern, rf"^((?:(?!{_WILD}).)*)", 1)
    folders = F.regexp_extract(literal, r"(?s)^(.*/)", 1)
    extension = F.regexp_extract(pattern, r"(?s)(?:[*?\]])[^*?\[\]/]*\.([^*?\[\]/.]+)$", 1)
    return F.when(folders != "", F.concat(F.lit("d:"), folders)).when(extension != "", F.concat(F.lit("e:"), extension)).otherwise("")


def path_keys(path: Column) -> Column:
    """All keys that a pattern matching this path can have."""
    parts = F.split(path, "/", -1)
    folders = F.transform(F.filter(F.sequence(F.lit(1), F.size(parts)), lambda n: n < F.size(parts)), lambda n: F.concat(F.lit("d:"), F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/")))
    extension = F.regexp_extract(path, r"\.([^/.]+)$", 1)
    return F.concat(folders, F.when(extension != "", F.array(F.concat(F.lit("e:"), extension), F.lit(""))).otherwise(F.array(F.lit(""))))


def matches(paths: DataFrame, patterns: DataFrame, source: str = "source", path: str = "path") -> DataFrame:
    """(source, path, kind, pattern) for each pattern (source, kind, pattern) that matches a path of its source."""
    ready(paths.sparkSession)
    rules = patterns.where("pattern is not null").select("source", "kind", "pattern").distinct()
    rules = rules.withColumns({"_key": pattern_key(F.col("pattern")), "_regex": _regex("pattern")})
    keyed = paths.select(F.col(source).alias("source"), F.col(path).alias("path")).withColumn("_key", F.explode(path_keys(F.col("path"))))
    return keyed.join(rules, ["source", "_key"]).where(F.regexp_like("path", F.col("_regex"))).select("source", "path", "kind", "pattern")


def selected(paths: DataFrame, patterns: DataFrame, source: str = "source", path: str = "path") -> DataFrame:
    """Distinct (source, path) that some "include" pattern of the source matches and no "exclude" pattern does."""
    kinds = matches(paths, patterns, source, path).groupBy("source", "path").agg(F.bool_or(F.col("kind") == "include").alias("_in"), F.bool_or(F.col("kind") == "exclude").alias("_out"))
    return kinds.where("_in and not _out").select("source", "path")
