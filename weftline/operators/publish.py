"""Publishing: allow-listed fields, redaction without permission, deep rewriting of strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.measure import metric_text
from ..functions.text import unescaped

# Labels of times in a text's lines, and what a time looks like.
TIME_LABELS = {
    "active_minutes": r"active(?: cooking)? time|hands.on time",
    "total_minutes": r"total(?: cooking)? time|ready in",
    "prep_minutes": r"prep(?:aration)?(?: time)?",
    "cook_minutes": r"cook(?:ing)? time",
}
HOURS = r"(?:([0-9]+(?:\.[0-9]+)?)\s*(?:hours?|hrs?|h|小时|小時))?"
MINUTES = r"(?:([0-9]+(?:\.[0-9]+)?)\s*(?:minutes?|mins?|m|分钟|分鐘))?"


def rewrite_strings(column: Column, kind: T.DataType, rewrite, skip: tuple[str, ...] = (), name: str = "") -> Column:
    """rewrite applied to every string inside a value of any nesting, but for fields named in skip."""
    if isinstance(kind, T.StringType):
        return column if name in skip else rewrite(column)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: rewrite_strings(x, kind.elementType, rewrite, skip, name))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda _, v: rewrite_strings(v, kind.valueType, rewrite, skip, name))
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*(rewrite_strings(column[f.name], f.dataType, rewrite, skip, f.name).alias(f.name) for f in kind.fields)))
    return column


#: Units that nothing published may name, and what stands where one could not be converted.
FORBIDDEN = r"(?i)\b(?:tsp|tbsp|teaspoons?|tablespoons?)\b"
PLACEHOLDER = "[volume measure unavailable]"


def without_units(text: Column) -> Column:
    """text in metric units; what is left of a forbidden unit becomes the placeholder. Null stays null."""
    return F.when(text.isNotNull(), F.regexp_replace(metric_text(text), FORBIDDEN, PLACEHOLDER))


def publish(rows: DataFrame, fields: list[str], rewrite=None, skip: tuple[str, ...] = (), redact: dict[str, Column] | None = None) -> DataFrame:
    """Only the allowed fields; arrays in redact are emptied unless their condition is true; strings are rewritten."""
    out = rows.select(*(c for c in fields if c in rows.columns), *(ok.alias(f"_ok_{c}") for c, ok in (redact or {}).items()))
    for c in redact or {}:
        out = out.withColumn(c, F.when(F.col(f"_ok_{c}"), F.col(c)).otherwise(F.array().cast(rows.schema[c].dataType)))
    out = out.drop(*(f"_ok_{c}" for c in redact or {}))
    if rewrite is None:
        return out
    return out.select(*(rewrite_strings(F.col(f.name), f.dataType, rewrite, skip, f.name).alias(f.name) for f in out.schema.fields))


def split_noise(rows: DataFrame, key: str, lines: Column, noise: str) -> tuple[DataFrame, DataFrame]:
    """(kept, decisions): lines that match the pattern are dropped, and each drop is logged with its position."""
    exploded = rows.select(key, F.posexplode(lines).alias("position", "line")).withColumn("is_noise", F.col("line").rlike(noise))
    return exploded.where("not is_noise").drop("is_noise"), exploded.where("is_noise").select(key, "position", "line", F.lit("navigation or empty fragment").alias("reason"))


def meaningful_items(rows: DataFrame, key: str, items: Column, name: str) -> tuple[DataFrame, DataFrame]:
    """(kept, decisions): items (an array of structs) whose name has a letter, and a log of the others with their positions."""
    lines = rows.select(key, F.posexplode(items).alias("position", "item"))
    known = F.coalesce(F.col(f"item.{name}").rlike(r"\p{L}"), F.lit(False))
    return lines.where(known), lines.where(~known).select(key, "position", "item", F.lit("quantity without ingredient identity").alias("reason"))


def positive(value: Column) -> Column:
    """A time that isn't positive is no time."""
    return F.when(value > 0, value)


def duration(text: Column) -> Column:
    """Minutes of "1 hr 20 min", "2小时", "45m"; null for any other text."""
    hours, minutes = (F.nullif(F.regexp_extract(F.trim(text), f"(?i)^{HOURS}\\s*{MINUTES}$", k), F.lit("")).cast("double") for k in (1, 2))
    return F.when(hours.isNotNull() | minutes.isNotNull(), F.coalesce(hours, F.lit(0.0)) * 60 + F.coalesce(minutes, F.lit(0.0)))


def labelled_times(text: Column) -> Column:
    """struct of minutes that lines of a text name by a label, the value beside it or in one of the next three lines; the first that reads as a time.

    Tags go and character references are read first, so a reference may end a line; a no-break space is a blank."""
    plain = F.regexp_replace(unescaped(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " ")), "\u00a0", " ")
    lines = F.transform(F.split(plain, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x: F.regexp_replace(x, r"^[\s#*_]+|[\s#*_]+$", ""))

    def field(label: str) -> Column:
        def value(rows: Column) -> Column:
            def at(x: Column, i: Column) -> Column:
                beside = F.trim(F.regexp_extract(x, rf"(?i)^(?:{label})[ :*_]*(.*)$", 1))
                below = F.get(F.filter(F.slice(rows, i + 2, F.lit(3)), lambda y: y != ""), F.lit(0))
                said = F.when(beside != "", beside).otherwise(F.coalesce(below, F.lit("")))
                return F.when(x.rlike(rf"(?i)^(?:{label})"), positive(duration(F.regexp_replace(said, r"^[*_ .]+|[*_ .]+$", ""))))

            return F.get(F.filter(F.transform(rows, at), lambda m: m.isNotNull()), F.lit(0))

        return F.transform(F.array(lines), value)[0]

    return F.struct(*(field(label).alias(name) for name, label in TIME_LABELS.items()))


def merged_times(times: Column, body: Column) -> Column:
    """times (a struct with fields of TIME_LABELS) with what a kept body says of fields that are null."""
    said = labelled_times(body)
    return F.transform(F.array(said), lambda t: F.struct(*(F.coalesce(times[name], t[name]).alias(name) for name in TIME_LABELS)))[0]


def reextracted(record: Column, parsed: Column, fields: list[str], body: Column | None = None, times: str = "times") -> Column:
    """record (a struct) with the fields that a second reading of its kept body gives, if that has items and steps; with body, times
    that are still null then come from its labelled lines, whether or not the reading was whole."""
    whole = F.coalesce((F.size(parsed["ingredients"]) > 0) & (F.size(parsed["instructions"]) > 0), F.lit(False))
    record = record.withField("reextracted", whole) if not fields else _with_fields(record, parsed, fields, whole)
    return record if body is None else record.withField(times, merged_times(record[times], body))


def _with_fields(record: Column, parsed: Column, fields: list[str], whole: Column) -> Column:
    for f in fields:
        record = record.withField(f, F.when(whole, F.coalesce(parsed[f], record[f])).otherwise(record[f]))
    return record.withField("reextracted", whole)


def license_url(source: Column, revision: Column, path: Column) -> Column:
    """Where a source's license stands at the pinned revision; null where one of the three is unknown."""
    given = (F.coalesce(path, F.lit("")) != "") & (F.coalesce(revision, F.lit("")) != "")
    return F.when(given, F.concat(F.regexp_replace(source, "/+$", ""), F.lit("/blob/"), revision, F.lit("/"), F.regexp_replace(F.regexp_replace(F.url_encode(path), "%2F", "/"), r"\+", "%20")))


def duplicate_variants(rows: DataFrame, members: DataFrame, key: str = "id", status: str = "status", why: str = "reasons") -> DataFrame:
    """rows with representative and is_representative. A recommended row that isn't its group's representative becomes a duplicate variant.

    members: (key, representative), a row for each record of a group; records of no group represent themselves."""
    out = rows.join(members.select(key, F.col("representative").alias("_first")), key, "left")
    first = F.coalesce("_first", key)
    out = out.withColumns({"representative": first, "is_representative": first == F.col(key)}).drop("_first")
    variant = ~F.col("is_representative") & (F.col(status) != "not-recommended")
    note = F.array(F.lit("exact duplicate retained; representative is used in recommendations"))
    return out.withColumns({why: F.when(variant, F.concat(F.coalesce(why, F.array().cast("array<string>")), note)).otherwise(F.col(why)), status: F.when(variant, "duplicate-variant").otherwise(F.col(status))})


def published(records: DataFrame, matches: DataFrame, members: DataFrame, captured: DataFrame, sources: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, withheld, aliases): one row for each representative with a match, the captured title, and its source's license.

    records: key, title, source, revision, raw_id, allowed, steps and what else is to be shown; matches: (key, score, state);
    members: (key, representative); captured: (raw_id, original_title); sources: (source, license_path). Each has at most a
    row for a key, so the joins neither add nor drop rows. Steps without permission are withheld and listed; records that
    another one represents become aliases."""
    state = records.where(F.col(key).isNotNull()).join(members.select(key, "representative"), key, "left")
    alias = state.where(F.col("representative") != F.col(key)).select(key, "representative")
    own = state.where(F.col("representative").isNull() | (F.col("representative") == F.col(key))).drop("representative")
    out = own.join(matches.select(key, "score", "state"), key, "left").join(captured.select("raw_id", "original_title"), "raw_id", "left").join(sources.select("source", "license_path"), "source", "left")
    allowed = F.coalesce(F.col("allowed"), F.lit(False))
    out = out.withColumns({
        "allowed": allowed, "steps": F.when(allowed, F.col("steps")).otherwise(F.array().cast(records.schema["steps"].dataType)), "state": F.coalesce("state", F.lit("unknown")),
        "original_title": F.coalesce("original_title", "title"), "license_url": license_url(F.col("source"), F.col("revision"), F.col("license_path")),
    }).drop("license_path")
    return out, out.where(~F.col("allowed")).select(key), alias
