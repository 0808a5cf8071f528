"""Configuration tables from YAML files: vocabularies, scoring weights, any mapping. Read through Spark, so a path may be in any store it reads."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession

from ..operators.scoring import Weights

MAX_BYTES = 16 << 20
VOCABULARY = "name string, category string, protein boolean, vegetable boolean, processed boolean, aliases array<string>"


def read_rules(spark: SparkSession, path: str) -> dict:
    """The mapping in a YAML file; an empty file is an empty mapping. A rule file is small: more than MAX_BYTES are an error."""
    import yaml

    files = spark.read.format("binaryFile").load(path).select("length", "content")
    if (n := files.agg({"length": "sum"}).first()[0] or 0) > MAX_BYTES:
        raise ValueError(f"{path} has {n} bytes; rules have at most {MAX_BYTES}")
    rows = files.collect()
    if len(rows) > 1:
        raise ValueError(f"{path} is {len(rows)} files, not one")
    out = yaml.safe_load("".join(bytes(r["content"]).decode("utf-8") for r in rows)) or {}  # an empty file gives no row
    if not isinstance(out, dict):
        raise ValueError(f"{path} holds no mapping")
    return out


def vocabulary_rows(spark: SparkSession, rules: dict, at: str = "ingredients") -> DataFrame:
    """A dimension table of the vocabulary: a row for each canonical name. Entries are lists of spellings or mappings with aliases and marks."""
    rows = []
    for name, entry in (rules.get(at) or {}).items():
        told = entry if isinstance(entry, dict) else {"aliases": entry}
        rows.append((str(name), told.get("category"), *(bool(told.get(k)) for k in ("protein", "vegetable", "processed")), [str(a) for a in told.get("aliases") or []]))
    return spark.createDataFrame(rows, VOCABULARY)


def entries(rules: dict, at: str = "ingredients") -> dict[str, list[str]]:
    """Canonical names to their spellings, as the item grammar takes them."""
    return {str(n): [str(a) for a in ((e.get("aliases") if isinstance(e, dict) else e) or [])] for n, e in (rules.get(at) or {}).items()}


def weights(rules: dict) -> Weights:
    """Weights with the values that rules give; an unknown name is an error, and the four weights must make 100."""
    known = {f.name for f in fields(Weights)}
    if unknown := sorted(set(rules) - known):
        raise ValueError(f"unknown weights {unknown}")
    return Weights(**{k: tuple(tuple(x) if isinstance(x, list) else x for x in v) if isinstance(v, list) else v for k, v in rules.items()})
