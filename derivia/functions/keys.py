"""Column expressions for keys, hashes and prompts."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(names) -> list[str]:
    """Names in the order of keys in canonical JSON: by length in bytes, then by bytes."""
    return sorted(names, key=lambda x: (len(x.encode()), x.encode()))


def json_of(names) -> Column:
    """Canonical JSON of the columns; nulls stay, so that null and absent differ."""
    return F.to_json(F.struct(*[F.col(f"`{x}`") for x in canonical(names)]), {"ignoreNullFields": "false"})


def row_key(pk) -> Column:
    return json_of(pk)


def row_order(pk, types: dict[str, str]) -> Column:
    """A string that sorts as the key does: whole numbers at a fixed width."""
    part = lambda c: F.lpad((F.col(f"`{c}`").cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("string"), 20, "0") if types[c] in ("bigint", "int", "smallint", "tinyint") else F.col(f"`{c}`").cast("string")
    return F.concat_ws("\x01", *[part(c) for c in pk])


def source_hash(sources) -> Column:
    return F.sha2(json_of(sources), 256)


def source_text(sources, types: dict[str, str]) -> Column:
    """One source as it is; several as lines `name: value` in canonical order, null as nothing, other types as JSON."""
    text = lambda c: F.coalesce(F.col(f"`{c}`") if types[c] == "string" else F.regexp_extract(F.to_json(F.struct(F.col(f"`{c}`").alias("v"))), r'^\{"v":(.*)\}$', 1) if types[c].startswith(("array", "map", "struct")) else F.col(f"`{c}`").cast("string"), F.lit(""))
    if len(sources) == 1:
        return text(sources[0])
    return F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), text(c)) for c in canonical(sources)])


def user_message(prompt: str, schema, text: Column) -> Column:
    """The prompt, the described options of an enum, and the data."""
    options = [f"Options:\n{chr(10).join(f'- {k}: {v}' for k, v in schema.items())}"] if isinstance(schema, dict) and schema and all(isinstance(v, str) for v in schema.values()) else []
    return F.concat(F.lit("\n\n".join([prompt, *options, "Data:\n"])), text)


def keyset_after(pk, cursor) -> Column:
    """Rows after the cursor in key order, as an OR of ANDs that scans can push down."""
    out = F.lit(False)
    for k, c in enumerate(pk):
        here = F.col(f"`{c}`") > F.lit(cursor[k])
        for j in range(k):
            here = (F.col(f"`{pk[j]}`") == F.lit(cursor[j])) & here
        out = here if k == 0 else out | here
    return out


def value_error(output_type: str, schema, value: Column) -> Column:
    """Null, or what is wrong with a JSON value under the type; null values are fine."""
    kind = F.substring(F.ltrim(value), 1, 1)
    as_double = F.when(kind.isin(*"-0123456789"), value.try_cast("double"))
    if output_type == "enum":
        values = list(schema)
        ok = (kind == '"') & F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "v string")["v"].isin(*values)
    elif output_type == "text":
        ok = kind == '"'
    elif output_type == "boolean":
        ok = F.trim(value).isin("true", "false")
    elif output_type == "integer":
        ok = as_double.isNotNull() & (as_double == F.floor(as_double))
    elif output_type == "numeric":
        ok = as_double.isNotNull()
    elif output_type in ("vector", "halfvec"):
        ok = F.coalesce(F.json_array_length(value) == schema["dimensions"], F.lit(False))
    else:
        ok = F.lit(True)
    missing = value.isNull() | (F.trim(value) == "null")
    return F.when(~missing & ~F.coalesce(ok, F.lit(False)), F.lit(f"not a value of type {output_type}"))


def typed_value(output_type: str, value: Column) -> Column:
    """A stored JSON value in the column's own type."""
    inner = F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "v string")["v"]
    if output_type in ("enum", "text"):
        return inner
    if output_type in ("vector", "halfvec"):
        return F.from_json(value, "array<float>")
    if output_type == "jsonb":
        return value
    if output_type == "integer":
        return value.try_cast("double").cast("int")
    return value.try_cast("boolean" if output_type == "boolean" else "decimal(38,18)")


def as_json(output_type: str, value: Column) -> Column:
    """A typed value as JSON text."""
    if output_type in ("enum", "text"):
        return F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'^\{"v":(.*)\}$', 1)
    return F.to_json(value) if output_type in ("vector", "halfvec") else value.cast("string")


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def described(schema) -> str:
    return json.dumps(schema, separators=(",", ":"), ensure_ascii=False)
