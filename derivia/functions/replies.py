"""What a model is asked to reply with, as JSON schema, and the check of replies against it as Column expressions over VARIANT."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from derivia.plans.catalog import DefinitionError, allowed_values

#: What a compiled schema may use; anything else raises when it is compiled, not when a reply comes.
KNOWN = {"type", "enum", "minimum", "maximum", "minLength", "maxLength", "required", "properties", "additionalProperties", "items", "description", "title"}


def value_schema(output_type: str, schema) -> dict:
    """The schema of a value of the output type under its declared limits."""
    limits = schema if isinstance(schema, dict) else {}
    if output_type == "enum":
        return {"type": "string", "enum": allowed_values(schema)}
    if output_type == "text":
        return {"type": "string"} | ({"maxLength": int(limits["max_length"])} if "max_length" in limits else {})
    if output_type in ("integer", "numeric"):
        bounds = {long: limits[short] for short, long in (("min", "minimum"), ("max", "maximum")) if short in limits}
        return {"type": "integer" if output_type == "integer" else "number"} | bounds
    if output_type == "jsonb":
        return limits or {"type": "object"}
    if output_type == "boolean":
        return {"type": "boolean"}
    raise DefinitionError(f"no reply has the type {output_type}")


def response_schema(output_type: str, schema) -> dict:
    """The schema of a whole reply: the value and how sure the model is, both required, and nothing else."""
    sure = {"type": "number", "minimum": 0, "maximum": 1}
    return {"type": "object", "properties": {"value": value_schema(output_type, schema), "confidence": sure}, "required": ["value", "confidence"], "additionalProperties": False}


def bound(value: Column, use) -> Column:
    """use(value), in which the value is computed once, however often it is used."""
    return F.try_element_at(F.transform(F.array(value), use), F.lit(1))


def has_type(kind: str, v: Column, told: Column) -> Column:
    """Whether a VARIANT, whose schema is told, is of the kind."""
    number = told.isin("BIGINT", "DOUBLE", "FLOAT") | told.startswith("DECIMAL")
    as_double = F.try_variant_get(v, "$", "double")
    return {
        "string": told == "STRING", "boolean": told == "BOOLEAN", "number": number, "integer": number & (as_double == F.floor(as_double)),
        "object": told.startswith("OBJECT"), "array": told.startswith("ARRAY"), "null": told == "VOID",
    }[kind]


def first_of(errors: list[Column]) -> Column:
    return F.coalesce(*errors, F.lit(None).cast("string"))


def violation(schema: dict, v: Column, name: str = "reply") -> Column:
    """Null, or the first thing that is wrong with a VARIANT under a JSON schema; limits are those of its type, so each is looked at where it applies only."""
    if set(schema) - KNOWN:
        raise DefinitionError(f"{name}: can't check {', '.join(sorted(set(schema) - KNOWN))}")
    if "enum" in schema and not all(isinstance(x, str) for x in schema["enum"]):
        raise DefinitionError(f"{name}: an enum must be of strings")
    return bound(F.struct(v.alias("v"), F.schema_of_variant(v).alias("told")), lambda x: first_of(violations(schema, x["v"], x["told"], name)))


def violations(schema: dict, v: Column, told: Column, name: str) -> list[Column]:
    wrong = lambda bad, text: F.when(F.coalesce(bad, F.lit(False)), F.lit(f"{name}: {text}"))
    out = []
    if "type" in schema:
        kinds = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        out.append(wrong(~reduce(Column.__or__, [has_type(k, v, told) for k in kinds]), f"not of type {' or '.join(kinds)}"))
    if "enum" in schema:
        text = F.when(has_type("string", v, told), F.try_variant_get(v, "$", "string"))
        out.append(wrong(~F.coalesce(text.isin(*schema["enum"]), F.lit(False)), "not an allowed value"))
    number = F.when(has_type("number", v, told), F.try_variant_get(v, "$", "double"))
    length = F.when(has_type("string", v, told), F.char_length(F.try_variant_get(v, "$", "string")))
    for key, bad, text in (("minimum", lambda x: number < x, "less than"), ("maximum", lambda x: number > x, "more than"), ("minLength", lambda x: length < x, "shorter than"), ("maxLength", lambda x: length > x, "longer than")):
        if key in schema:
            out.append(wrong(bad(schema[key]), f"{text} {schema[key]}"))

    def of_fields(fields: Column) -> Column:
        bad = [wrong(~F.map_contains_key(fields, x), f"no {x}") for x in schema.get("required", [])]
        if schema.get("additionalProperties", True) is False:
            bad.append(wrong(F.size(F.array_except(F.map_keys(fields), F.array(*map(F.lit, schema.get("properties", {}))).cast("array<string>"))) > 0, "other fields than asked for"))
        return first_of(bad + [F.when(F.map_contains_key(fields, k), violation(s, F.try_element_at(fields, F.lit(k)), k)) for k, s in schema.get("properties", {}).items()])

    if schema.get("required") or schema.get("properties") or schema.get("additionalProperties", True) is False:
        out.append(bound(F.when(has_type("object", v, told), F.try_variant_get(v, "$", "map<string,variant>")), of_fields))
    if "items" in schema:
        parts = F.when(has_type("array", v, told), F.try_variant_get(v, "$", "array<variant>"))
        bad = F.filter(F.transform(parts, lambda x: violation(schema["items"], x, f"an item of {name}")), lambda e: e.isNotNull())
        out.append(F.try_element_at(bad, F.lit(1)))
    return out


def parsed(reply: Column) -> Column:
    """The JSON of a reply as VARIANT, bare or in a fence with whatever follows that; null where there is none."""
    bare = F.regexp_replace(reply, r"^\s*```[a-zA-Z]*\s*", "")
    return bound(bare, lambda b: F.coalesce(F.try_parse_json(b), F.try_parse_json(F.regexp_replace(b, r"\s*```[\s\S]*$", ""))))


def checked(output_type: str, schema, reply: Column) -> Column:
    """A reply as a struct of value (JSON), confidence and error: the error alone, or the others. A null reply is an error."""
    whole = response_schema(output_type, schema)

    def told(v: Column, error: Column) -> Column:
        value, sure = F.to_json(F.try_variant_get(v, "$.value", "variant")), F.try_variant_get(v, "$.confidence", "double")
        return F.struct(F.when(error.isNull(), value).alias("value"), F.when(error.isNull(), sure).alias("confidence"), error.alias("error"))

    error = lambda v: F.when(v.isNull(), F.lit("reply: not JSON")).otherwise(violation(whole, v))
    return bound(parsed(reply), lambda v: bound(error(v), lambda e: told(v, e)))
