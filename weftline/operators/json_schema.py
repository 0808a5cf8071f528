"""JSON Schema compiled to Column rules over VARIANT values.

A schema becomes one expression that gives all faults of a value, each with its path ($, $.items[2].unit) and the keyword
that it breaks. Documents are parsed once; rules read their fields from the binary form, in the tasks, without Python.

What is read: type, enum, const; minimum, maximum, exclusiveMinimum, exclusiveMaximum, multipleOf; minLength, maxLength,
pattern; items, prefixItems, contains, minContains, maxContains, minItems, maxItems, uniqueItems; properties,
patternProperties, additionalProperties, required, propertyNames, minProperties, maxProperties, dependentRequired; allOf,
anyOf, oneOf, not, if, then, else; $ref to a definition of the same schema; true and false. Annotations are skipped. Any other
keyword is an error, as is a schema that refers to itself, so that no rule is passed over in silence.

Numbers are compared as 64-bit integers where both sides are, else as doubles. Patterns are Java's, searched for anywhere.
A fault of a subschema of anyOf, oneOf, not or contains is reported as that keyword at the value's own path.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FAULTS = "array<struct<path:string,keyword:string>>"

# Keywords that assert nothing here.
ANNOTATIONS = {
    "$schema",
    "$id",
    "$anchor",
    "$comment",
    "$defs",
    "definitions",
    "title",
    "description",
    "default",
    "examples",
    "deprecated",
    "readOnly",
    "writeOnly",
    "format",
    "contentEncoding",
    "contentMediaType",
    "contentSchema",
}


def read_schemas(spark: SparkSession, path: str | list[str]) -> dict[str, dict]:
    """Schemas by file name without suffix; each is compiled once, so that faults in them show at once."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value").collect()  # a schema for each kind of record
    out = {r["name"].removesuffix(".json"): json.loads(r["value"]) for r in rows}
    for schema in out.values():
        compiled(schema)
    return out


def compiled(schema: dict | bool) -> Callable[[Column], Column]:
    """A function from a VARIANT column to its faults (FAULTS); a missing value (SQL null) has the fault "json" at $."""
    it = _Compiler(schema)
    it.check(schema, ())
    return lambda value: F.when(value.isNull(), F.array(_fault(F.lit("$"), "json"))).otherwise(it.faults(schema, value, F.lit("$")))


def json_faults(rows: DataFrame, key: list[str], text: Column, schema: dict | bool) -> DataFrame:
    """(key, path, keyword) of JSON texts; a text that is null or no JSON has the fault "json"."""
    return _exploded(rows, key, F.try_parse_json(text), schema)


def record_faults(rows: DataFrame, key: list[str], schema: dict | bool, columns: list[str] | None = None, absent: bool = True) -> DataFrame:
    """(key, path, keyword) of rows themselves, each an object of some columns (all where columns isn't given).

    absent: a top-level column that is null counts as a property that isn't there, else as JSON's null."""
    whole = F.struct(*(columns or rows.columns))
    value = F.try_parse_json(F.to_json(whole)) if absent else F.to_variant_object(whole)
    return _exploded(rows, key, value, schema)


def _exploded(rows: DataFrame, key: list[str], value: Column, schema: dict | bool) -> DataFrame:
    found = _let(value, compiled(schema))
    return rows.select(*key, F.explode(found).alias("_fault")).select(*key, "_fault.path", "_fault.keyword")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def _fault(path: Column, keyword: str) -> Column:
    return F.struct(path.alias("path"), F.lit(keyword).alias("keyword"))


def _none() -> Column:
    return F.array().cast(FAULTS)


@dataclass
class _Compiler:
    root: dict | bool

    def check(self, schema: dict | bool, inside: tuple[str, ...]) -> None:
        """Raises ValueError for what can't be compiled."""
        if isinstance(schema, bool):
            return
        if not isinstance(schema, dict):
            raise ValueError(f"a schema is an object or a boolean, not {schema!r}")
        for keyword, value in schema.items():
            if keyword in ANNOTATIONS:
                continue
            if keyword not in _KEYWORDS:
                raise ValueError(f"keyword {keyword} isn't read")
            if keyword == "$ref":
                if value in inside:
                    raise ValueError(f"{value} refers to itself")
                self.check(self.resolved(value), (*inside, value))
            for inner in _subschemas(keyword, value):
                self.check(inner, inside)

    def resolved(self, ref: str) -> dict | bool:
        if not ref.startswith("#"):
            raise ValueError(f"{ref} is another document's")
        at = self.root
        for name in ref[1:].split("/")[1:]:
            name = name.replace("~1", "/").replace("~0", "~")
            if not isinstance(at, dict) or name not in at:
                raise ValueError(f"{ref} isn't there")
            at = at[name]
        return at

    def faults(self, schema: dict | bool, value: Column, path: Column) -> Column:
        """The faults of a value that is there."""
        if schema is True or (isinstance(schema, dict) and not set(schema) - ANNOTATIONS):
            return _none()
        if schema is False:
            return F.array(_fault(path, "false"))
        kind = F.schema_of_variant(value)
        return _let(F.struct(value.alias("v"), F.regexp_extract(kind, "^[A-Z]+", 0).alias("k"), path.alias("p")), lambda x: self._told(schema, x["v"], x["k"], x["p"]))

    def _told(self, schema: dict, v: Column, k: Column, path: Column) -> Column:
        is_ = {"object": k == "OBJECT", "array": k == "ARRAY", "string": k == "STRING", "boolean": k == "BOOLEAN", "null": k == "VOID"}
        whole = k.isin("BIGINT", "INT", "SMALLINT", "TINYINT")
        number = whole | k.isin("DECIMAL", "DOUBLE", "FLOAT")
        real, text = F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "string")
        is_ |= {"number": number, "integer": whole | (number & (real == F.rint(real)))}
        broken: list[tuple[str, Column]] = []  # keyword, condition that it is broken
        parts: list[Column] = []  # faults of subschemas

        def inner(name, at, where):
            return self.faults(schema[name], at, where)

        if "$ref" in schema:
            parts.append(self.faults(self.resolved(schema["$ref"]), v, path))
        if "type" in schema:
            names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
            broken.append(("type", ~_any([is_[n] for n in names])))
        for name, members in (("enum", schema.get("enum")), ("const", [schema["const"]] if "const" in schema else None)):
            if members is not None:
                broken.append((name, ~_any([_equals(v, k, number, real, text, m) for m in members])))

        def ordered(bound, compare):
            exact = whole & compare(F.try_variant_get(v, "$", "bigint"), F.lit(bound)) if isinstance(bound, int) and abs(bound) < 1 << 63 else None
            near = compare(real, F.lit(float(bound)))
            return F.when(whole, exact).otherwise(near) if exact is not None else near

        for name, compare in (("minimum", lambda a, b: a < b), ("maximum", lambda a, b: a > b), ("exclusiveMinimum", lambda a, b: a <= b), ("exclusiveMaximum", lambda a, b: a >= b)):
            if name in schema:
                broken.append((name, number & ordered(schema[name], compare)))
        if "multipleOf" in schema:
            m = schema["multipleOf"]
            by = real / F.lit(float(m))
            off = by != F.rint(by)
            broken.append(("multipleOf", number & (F.when(whole, F.try_variant_get(v, "$", "bigint") % F.lit(m) != 0).otherwise(off) if isinstance(m, int) else off)))
        for name, compare in (("minLength", lambda n, b: n < b), ("maxLength", lambda n, b: n > b)):
            if name in schema:
                broken.append((name, is_["string"] & compare(F.length(text), F.lit(schema[name]))))
        if "pattern" in schema:
            broken.append(("pattern", is_["string"] & ~F.regexp_like(text, F.lit(schema["pattern"]))))

        items = F.try_variant_get(v, "$", "array<variant>")
        for name, compare in (("minItems", lambda n, b: n < b), ("maxItems", lambda n, b: n > b)):
            if name in schema:
                broken.append((name, is_["array"] & compare(F.size(items), F.lit(schema[name]))))
        if schema.get("uniqueItems"):
            broken.append(("uniqueItems", is_["array"] & (F.size(F.array_distinct(F.transform(items, lambda e: F.to_json(e)))) < F.size(items))))
        first = schema.get("prefixItems", [])
        at = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        for n, sub in enumerate(first):
            parts.append(F.when(is_["array"] & (F.size(items) > n), self.faults(sub, F.get(items, F.lit(n)), at(F.lit(n)))))
        if "items" in schema:
            each = F.transform(items, lambda e, i: F.when(i >= len(first), inner("items", e, at(i))).otherwise(_none()))
            parts.append(F.when(is_["array"], F.flatten(each)))
        if "contains" in schema:
            n = F.size(F.filter(items, lambda e: F.size(inner("contains", e, path)) == 0))
            broken.append(("contains", is_["array"] & (n < schema.get("minContains", 1))))
            if "maxContains" in schema:
                broken.append(("maxContains", is_["array"] & (n > schema["maxContains"])))

        fields = F.try_variant_get(v, "$", "map<string,variant>")
        named = {name: _property(v, name) for name in {*schema.get("properties", {}), *schema.get("required", ())}}
        below = lambda name: F.concat(path, F.lit("."), name)
        for name in schema.get("required", ()):
            parts.append(F.when(is_["object"] & named[name].isNull(), F.array(_fault(below(F.lit(name)), "required"))))
        for name, sub in schema.get("properties", {}).items():
            parts.append(F.when(is_["object"] & named[name].isNotNull(), self.faults(sub, named[name], below(F.lit(name)))))
        patterns = schema.get("patternProperties", {})
        for pattern, sub in patterns.items():
            # Lambdas are called at once, so they see this round's pattern and schema.
            mine = F.filter(F.map_keys(fields), lambda n: F.regexp_like(n, F.lit(pattern)))
            parts.append(F.when(is_["object"], F.flatten(F.transform(mine, lambda n: self.faults(sub, F.element_at(fields, n), below(n))))))
        if schema.get("additionalProperties", True) is not True:
            known = [*schema.get("properties", {})]
            other = F.filter(F.map_keys(fields), lambda n: ~_any([*([n.isin(*known)] if known else []), *(F.regexp_like(n, F.lit(p)) for p in patterns)]))
            if schema["additionalProperties"] is False:
                parts.append(F.when(is_["object"], F.transform(other, lambda n: _fault(below(n), "additionalProperties"))))
            else:
                parts.append(F.when(is_["object"], F.flatten(F.transform(other, lambda n: inner("additionalProperties", F.element_at(fields, n), below(n))))))
        if "propertyNames" in schema:
            bad = F.filter(F.map_keys(fields), lambda n: F.size(self.faults(schema["propertyNames"], F.try_variant_get(F.parse_json(F.to_json(F.array(n))), "$[0]", "variant"), path)) > 0)
            parts.append(F.when(is_["object"], F.transform(bad, lambda n: _fault(below(n), "propertyNames"))))
        for name, compare in (("minProperties", lambda n, b: n < b), ("maxProperties", lambda n, b: n > b)):
            if name in schema:
                broken.append((name, is_["object"] & compare(F.size(fields), F.lit(schema[name]))))
        for name, needed in schema.get("dependentRequired", {}).items():
            for other in needed:
                parts.append(F.when(is_["object"] & _property(v, name).isNotNull() & _property(v, other).isNull(), F.array(_fault(below(F.lit(other)), "dependentRequired"))))

        good = lambda sub: F.size(self.faults(sub, v, path)) == 0
        parts += [self.faults(sub, v, path) for sub in schema.get("allOf", [])]
        if "anyOf" in schema:
            broken.append(("anyOf", ~_any([good(s) for s in schema["anyOf"]])))
        if "oneOf" in schema:
            broken.append(("oneOf", sum((good(s).cast("int") for s in schema["oneOf"]), F.lit(0)) != 1))
        if "not" in schema:
            broken.append(("not", good(schema["not"])))
        if "if" in schema:
            yes, no = (self.faults(schema[n], v, path) if n in schema else _none() for n in ("then", "else"))
            parts.append(F.when(good(schema["if"]), yes).otherwise(no))

        own = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), _fault(path, name)) for name, c in broken)), lambda f: f.isNotNull()) if broken else _none()
        return F.concat(own.cast(FAULTS), *(F.coalesce(p.cast(FAULTS), _none()) for p in parts))


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def _property(v: Column, name: str) -> Column:
    if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        return F.try_variant_get(v, f"$.{name}", "variant")
    return F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), F.lit(name))


def _equals(v: Column, k: Column, number: Column, real: Column, text: Column, member) -> Column:
    if member is None:
        return k == "VOID"
    if isinstance(member, bool):
        return (k == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == F.lit(member))
    if isinstance(member, int | float):
        return number & (real == F.lit(float(member)))
    if isinstance(member, str):
        return (k == "STRING") & (text == F.lit(member))
    return F.to_json(v) == F.to_json(F.parse_json(F.lit(json.dumps(member))))


def _subschemas(keyword: str, value) -> list:
    if keyword in ("properties", "patternProperties"):
        return [*value.values()]
    if keyword in ("allOf", "anyOf", "oneOf", "prefixItems"):
        return [*value]
    if keyword in ("items", "contains", "additionalProperties", "propertyNames", "not", "if", "then", "else"):
        return [value]
    return []


# Keywords that are read.
_KEYWORDS = {
    "$ref",
    "type",
    "enum",
    "const",
    "minimum",
    "maximum",
    "exclusiveMinimum",
    "exclusiveMaximum",
    "multipleOf",
    "minLength",
    "maxLength",
    "pattern",
    "items",
    "prefixItems",
    "contains",
    "minContains",
    "maxContains",
    "minItems",
    "maxItems",
    "uniqueItems",
    "properties",
    "patternProperties",
    "additionalProperties",
    "required",
    "propertyNames",
    "minProperties",
    "maxProperties",
    "dependentRequired",
    "allOf",
    "anyOf",
    "oneOf",
    "not",
    "if",
    "then",
    "else",
}
