"""Replies of models against the schema that they were asked for."""

import pytest
from pyspark.sql import functions as F

from derivia.functions import replies
from derivia.plans.catalog import DefinitionError


def verdicts(spark, output_type, schema, texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, reply string")
    got = rows.select("k", replies.checked(output_type, schema, F.col("reply")).alias("c")).orderBy("k").collect()
    return [(r["c"]["value"], r["c"]["confidence"], r["c"]["error"]) for r in got]


def test_replies_of_plain_types(spark):
    got = verdicts(spark, "integer", {"min": 1, "max": 9}, [
        '{"value": 3, "confidence": 1}', '{"value": 3.0, "confidence": 0.25}', '{"value": 3.5, "confidence": 1}', '{"value": true, "confidence": 1}', '{"value": 10, "confidence": 1}', '{"value": 0, "confidence": 1}',
        '{"value": 3, "confidence": null}', '{"value": 3, "confidence": -0.1}', '{"confidence": 1}', "{}", None, "", "null", '```json\n{"value": 4, "confidence": 0}\n```',
    ])
    assert got[0] == ("3", 1.0, None) and got[1][1:] == (0.25, None) and got[13] == ("4", 0.0, None)
    assert [e for _, _, e in got[2:13]] == [
        "value: not of type integer", "value: not of type integer", "value: more than 9", "value: less than 1", "confidence: not of type number", "confidence: less than 0", "reply: no value", "reply: no value",
        "reply: not JSON", "reply: not JSON", "reply: not of type object",
    ]
    assert all(v is None and c is None for v, c, e in got if e)
    text = verdicts(spark, "text", {"max_length": 3}, ['{"value": "äöü", "confidence": 1}', '{"value": "abcd", "confidence": 1}', '{"value": "``` x", "confidence": 1}', '{"value": "", "confidence": 1}'])
    assert [e for _, _, e in text] == [None, "value: longer than 3", "value: longer than 3", None] and text[0][0] == '"äöü"'
    assert verdicts(spark, "boolean", {}, ['{"value": false, "confidence": 1}', '{"value": "no", "confidence": 1}']) == [("false", 1.0, None), (None, None, "value: not of type boolean")]


def test_replies_of_nested_objects(spark):
    schema = {"type": "object", "required": ["tags"], "additionalProperties": False, "properties": {"tags": {"type": "array", "items": {"type": "string", "minLength": 1}}, "n": {"type": ["integer", "null"]}}}
    texts = [f'{{"value": {v}, "confidence": 1}}' for v in ('{"tags": ["a", "b"], "n": null}', '{"tags": []}', '{"tags": ["a", ""]}', '{"tags": ["a", 1]}', '{"n": 1}', '{"tags": [], "x": 1}', '{"tags": "a"}', '{"tags": [], "n": 0.5}')]
    assert [e for _, _, e in verdicts(spark, "jsonb", schema, texts)] == [None, None, "an item of tags: shorter than 1", "an item of tags: not of type string", "value: no tags", "value: other fields than asked for", "tags: not of type array", "n: not of type integer or null"]
    with pytest.raises(DefinitionError, match="pattern"):
        verdicts(spark, "jsonb", {"type": "object", "properties": {"a": {"pattern": "x"}}}, ["{}"])
    with pytest.raises(DefinitionError):
        replies.response_schema("vector", {"dimensions": 3})


def test_a_reply_is_parsed_and_taken_apart_once(spark):
    rows = spark.createDataFrame([('{"value": "a", "confidence": 1}',)], "reply string")
    plan = rows.select(replies.checked("enum", ["a", "b"], F.col("reply")))._jdf.queryExecution().optimizedPlan().toString()
    # bare, and without what follows a fence; the fields once
    assert plan.count("parse_json(") + plan.count("parseJson,") <= 2 and plan.count("MapType(StringType,VariantType") + plan.count("map<string,variant>") <= 1
