"""Every keyword of the schema compiler, with values that keep it and values that break it."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.operators import json_schema

ITEM = {"type": "object", "required": ["name", "unit"], "properties": {"name": {"type": "string", "minLength": 1}, "unit": {"enum": ["g", "kg", None]}, "amount": {"type": ["number", "null"], "minimum": 0}}}
RECORD = {
    "$schema": "https://json-schema.org/draft/2020-12/schema", "type": "object", "required": ["id", "items"],
    "properties": {"id": {"type": "string", "pattern": "^r[0-9]+$"}, "items": {"type": "array", "items": {"$ref": "#/$defs/item"}}, "odd name!": {"const": 3}},
    "$defs": {"item": ITEM},
}

# schema, then values with their faults (path, keyword)
CASES = [
    (True, [("1", []), ("nonsense", [("$", "json")])]),
    (False, [("{}", [("$", "false")])]),
    ({"title": "only told"}, [("[]", [])]),
    ({"type": "integer"}, [("1", []), ("1.0", []), ("1e3", []), ("1.5", [("$", "type")]), ('"1"', [("$", "type")]), ("true", [("$", "type")]), ("12345678901234567890", [])]),
    ({"type": ["number", "null"]}, [("1.5", []), ("null", []), ("false", [("$", "type")])]),
    ({"type": "boolean"}, [("true", []), ("0", [("$", "type")])]),
    ({"enum": [1, "a", None, True, [1, {"x": 2}]]}, [("1.0", []), ('"a"', []), ("null", []), ("true", []), ('[1, {"x":2}]', []), ("false", [("$", "enum")]), ('"1"', [("$", "enum")]), ("[1]", [("$", "enum")])]),
    ({"const": "x"}, [('"x"', []), ('"y"', [("$", "const")])]),
    ({"minimum": 2, "exclusiveMaximum": 5.5}, [("2", []), ("5.4", []), ("5.5", [("$", "exclusiveMaximum")]), ("1", [("$", "minimum")]), ('"0"', [])]),
    ({"exclusiveMinimum": 9007199254740993}, [("9007199254740994", []), ("9007199254740993", [("$", "exclusiveMinimum")])]),
    ({"maximum": 3}, [("3", []), ("3.01", [("$", "maximum")])]),
    ({"multipleOf": 3}, [("9", []), ("10", [("$", "multipleOf")]), ("4.5", [("$", "multipleOf")])]),
    ({"multipleOf": 0.5}, [("4.5", []), ("4.4", [("$", "multipleOf")])]),
    ({"minLength": 2, "maxLength": 3, "pattern": "b"}, [('"ab"', []), ('"b"', [("$", "minLength")]), ('"漢字🙂b"', [("$", "maxLength")]), ('"aa"', [("$", "pattern")]), ("7", [])]),
    ({"minItems": 1, "maxItems": 2, "uniqueItems": True}, [("[1]", []), ("[]", [("$", "minItems")]), ("[1,2,3]", [("$", "maxItems")]), ('[{"a":1,"b":2},{"b":2,"a":1}]', [("$", "uniqueItems")]), ("{}", [])]),
    ({"prefixItems": [{"type": "string"}], "items": {"type": "integer"}}, [('["a", 1]', []), ("[1, 2]", [("$[0]", "type")]), ('["a", "b", null]', [("$[1]", "type"), ("$[2]", "type")]), ("[]", [])]),
    ({"contains": {"minimum": 5}, "minContains": 2, "maxContains": 3}, [("[5,6]", []), ("[5,1]", [("$", "contains")]), ("[5,6,7,8]", [("$", "maxContains")])]),
    ({"properties": {"a": {"type": "integer"}}, "additionalProperties": False, "patternProperties": {"^x-": {"type": "string"}}}, [('{"a":1,"x-b":"c"}', []), ('{"a":"1"}', [("$.a", "type")]), ('{"x-b":1,"c":2}', [("$.x-b", "type"), ("$.c", "additionalProperties")])]),
    ({"additionalProperties": {"type": "integer"}}, [('{"a":1}', []), ('{"a":1,"b c":null}', [("$.b c", "type")])]),
    ({"propertyNames": {"pattern": "^[a-z]+$", "maxLength": 2}}, [('{"ab":1}', []), ('{"A":1,"abc":2}', [("$.A", "propertyNames"), ("$.abc", "propertyNames")])]),
    ({"minProperties": 1, "maxProperties": 1}, [('{"a":1}', []), ("{}", [("$", "minProperties")]), ('{"a":1,"b":1}', [("$", "maxProperties")])]),
    ({"dependentRequired": {"a": ["b", "c"]}}, [('{"a":1,"b":1,"c":null}', []), ('{"a":1,"b":1}', [("$.c", "dependentRequired")]), ("{}", [])]),
    ({"allOf": [{"minimum": 1}, {"maximum": 0}]}, [("0.5", [("$", "minimum"), ("$", "maximum")])]),
    ({"anyOf": [{"type": "string"}, {"minimum": 3}]}, [('"a"', []), ("3", []), ("1", [("$", "anyOf")])]),
    ({"oneOf": [{"minimum": 3}, {"maximum": 5}]}, [("1", []), ("4", [("$", "oneOf")])]),
    ({"not": {"type": "null"}}, [("1", []), ("null", [("$", "not")])]),
    ({"if": {"required": ["a"]}, "then": {"required": ["b"]}, "else": {"maxProperties": 0}}, [('{"a":1,"b":2}', []), ('{"a":1}', [("$.b", "required")]), ('{"c":1}', [("$", "maxProperties")]), ("{}", [])]),
    (RECORD, [
        ('{"id":"r1","items":[]}', []), ('{"id":"r1","items":[{"name":"a","unit":null,"amount":null}],"odd name!":3}', []),
        ('{"id":"x","items":[{"name":"","unit":"g"},{"unit":"lb","amount":-1}],"odd name!":4}', [("$.id", "pattern"), ("$.items[0].name", "minLength"), ("$.items[1].name", "required"), ("$.items[1].unit", "enum"), ("$.items[1].amount", "minimum"), ("$.odd name!", "const")]),
        ("[]", [("$", "type")]), ('{"id":null}', [("$.id", "type"), ("$.items", "required")]),
    ]),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_keyword(spark, k):
    schema, values = CASES[k]
    rows = spark.createDataFrame([(n, text) for n, (text, _) in enumerate(values)] + [(-1, None)], "n int, text string")
    got = {}
    for r in json_schema.json_faults(rows, ["n"], F.col("text"), schema).collect():
        got.setdefault(r["n"], []).append((r["path"], r["keyword"]))
    assert got.pop(-1) == [("$", "json")]
    for n, (text, want) in enumerate(values):
        assert sorted(got.get(n, [])) == sorted(want), text


@pytest.mark.parametrize(
    "bad", [{"unevaluatedProperties": False}, {"properties": {"a": {"minimun": 1}}}, {"$ref": "#/$defs/none"}, {"$ref": "other.json"}, {"$defs": {"a": {"items": {"$ref": "#/$defs/a"}}}, "$ref": "#/$defs/a"}, {"not": 3}]
)
def test_what_is_not_read_is_an_error(bad):
    with pytest.raises(ValueError):
        json_schema.compiled(bad)


def test_rows_and_files(spark, tmp_path):
    (tmp_path / "record.json").write_text(json.dumps(RECORD))
    (tmp_path / "any.json").write_text("{}")
    schemas = json_schema.read_schemas(spark, str(tmp_path))
    assert set(schemas) == {"record", "any"}
    rows = spark.createDataFrame([("r1", [("a", "g", 1.5)]), ("q", [("a", None, -1.0)]), (None, None)], "id string, items array<struct<name:string,unit:string,amount:double>>")
    got = {(r["id"], r["path"], r["keyword"]) for r in json_schema.record_faults(rows, ["id"], schemas["record"]).collect()}
    assert got == {("q", "$.id", "pattern"), ("q", "$.items[0].unit", "required"), ("q", "$.items[0].amount", "minimum"), (None, "$.id", "required"), (None, "$.items", "required")}
    nulls = {(r["path"], r["keyword"]) for r in json_schema.record_faults(rows.where("id is null"), ["id"], schemas["record"], absent=False).collect()}
    assert nulls == {("$.id", "type"), ("$.items", "type")}
    assert json_schema.record_faults(rows, ["id"], schemas["any"]).collect() == []
    plan = json_schema.json_faults(rows, ["id"], F.col("id"), schemas["record"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
