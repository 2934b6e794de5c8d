"""Declarations of derived columns: definitions, their immutable versions, configuration, and what makes them valid."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

OUTPUT_TYPES = ("enum", "text", "boolean", "integer", "numeric", "jsonb", "vector", "halfvec")
BACKENDS = ("llm", "embedding", "custom", "decision")
SPARK_TYPE = {"enum": "string", "text": "string", "boolean": "boolean", "integer": "int", "numeric": "decimal(38,18)", "jsonb": "string", "vector": "array<float>", "halfvec": "array<float>"}

# The defaults of a column's configuration.
DEFAULTS = {
    "batch_size": 20, "concurrency": 4, "max_attempts": 5, "backoff_base_seconds": 30, "confidence_threshold": 0.7, "low_confidence_policy": "write",
    "override_policy": "pin", "budget_usd": None, "budget_period": "month", "backfill_chunk": 1000, "lineage_retention_days": None,
}


class DefinitionError(ValueError):
    """A declaration or a configuration that can't be."""


def number(x) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool)


def check_config(config: dict) -> None:
    """Raise where a configured value can't be; unknown keys are kept as they are."""
    whole = lambda x, a, b: isinstance(x, int) and not isinstance(x, bool) and a <= x <= b
    for key in ("budget_usd", "input_usd_per_mtok", "output_usd_per_mtok"):
        if (v := config.get(key)) is not None and not (number(v) and v >= 0):
            raise DefinitionError(f"{key} must be null or a number of at least 0")
    if config.get("budget_period", "month") not in ("day", "month", "total"):
        raise DefinitionError("budget_period must be day, month or total")
    if "backfill_chunk" in config and not whole(config["backfill_chunk"], 1, 100_000):
        raise DefinitionError("backfill_chunk must be an integer from 1 to 100000")
    if (v := config.get("lineage_retention_days")) is not None and not whole(v, 1, 1 << 31):
        raise DefinitionError("lineage_retention_days must be null or an integer of at least 1")


def allowed_values(schema) -> list[str] | None:
    """The values of an enum, from a list or from an object of descriptions."""
    if isinstance(schema, dict):
        schema = list(schema)
    ok = isinstance(schema, list) and schema and all(isinstance(x, str) for x in schema)
    return schema if ok else None


def check_definition(backend: str, output_type: str, model: str | None, prompt: str | None, schema) -> None:
    """Raise where backend, type and schema don't go together."""
    if backend not in BACKENDS or output_type not in OUTPUT_TYPES:
        raise DefinitionError(f"unknown backend or output type: {backend}, {output_type}")
    vector = output_type in ("vector", "halfvec")
    if not model:
        raise DefinitionError("a model is required")
    if backend in ("llm", "decision") and not prompt:
        raise DefinitionError(f"{backend} needs a prompt")
    if backend in ("llm", "decision") and vector:
        raise DefinitionError(f"{backend} can't make vectors")
    if backend == "embedding" and not vector:
        raise DefinitionError("embedding makes vectors only")
    if backend == "decision":
        if output_type not in ("enum", "boolean", "integer", "numeric"):
            raise DefinitionError("decision answers enum, boolean, integer or numeric")
        if output_type == "enum" and not isinstance(schema, dict):
            raise DefinitionError("a decision enum needs a description for each value")
        if output_type in ("integer", "numeric") and not 2 <= len((schema or {}).get("levels", [])) <= 10:
            raise DefinitionError("a score needs 2 to 10 levels")
    if output_type == "enum" and allowed_values(schema) is None:
        raise DefinitionError("an enum needs its values")
    if vector and not (isinstance(schema, dict) and isinstance(schema.get("dimensions"), int) and schema["dimensions"] > 0):
        raise DefinitionError("a vector needs its dimensions")


@dataclass(frozen=True)
class Version:
    """What a value is computed by; never changed once made."""

    number: int
    backend: str
    model: str | None
    prompt: str | None
    schema: object
    backend_config: dict


@dataclass(frozen=True)
class Definition:
    """A derived column of a table."""

    def_id: int
    table: str
    column: str
    pk: tuple[str, ...]
    sources: tuple[str, ...]
    output_type: str
    versions: tuple[Version, ...]
    config: dict
    enabled: bool = True
    deleted: bool = False
    backfill_pending: bool = True
    backfill_scanned: int = 0
    backfill_cursor: tuple | None = None
    #: the clustered copy that a running scan reads
    backfill_scan: dict | None = None

    @property
    def current(self) -> Version:
        return self.versions[-1]


@dataclass(frozen=True)
class Catalog:
    """All definitions, dropped ones included; every change gives a new catalog."""

    defs: tuple[Definition, ...] = field(default_factory=tuple)

    def find(self, table: str, column: str) -> Definition:
        for d in self.defs:
            if (d.table, d.column, d.deleted) == (table, column, False):
                return d
        raise DefinitionError(f"{table}.{column} isn't a derived column")

    def by_id(self, def_id: int) -> Definition:
        return next(d for d in self.defs if d.def_id == def_id)

    def put(self, changed: Definition) -> Catalog:
        return Catalog(tuple(changed if d.def_id == changed.def_id else d for d in self.defs))

    def add_column(self, table: str, column: str, pk, sources, output_type: str, backend: str = "llm", prompt: str | None = None, model: str | None = None, schema=None, backend_config: dict | None = None, config: dict | None = None, fields: dict[str, str] | None = None) -> tuple[Catalog, Definition]:
        """Declare a column; fields (name -> Spark type of the table), where given, must have key and sources, and an existing target of the very type."""
        pk, sources = tuple(pk), tuple(sources)
        schema = {} if schema is None else schema
        if not pk:
            raise DefinitionError(f"{table} has no primary key")
        if not sources:
            raise DefinitionError("at least one source column is needed")
        for c in (*pk, *sources):
            if fields is not None and c not in fields:
                raise DefinitionError(f"{table} has no column {c}")
        if column in sources or column in pk:
            raise DefinitionError("the target is a source or in the key")
        if fields is not None and column in fields and fields[column] != SPARK_TYPE[output_type]:
            raise DefinitionError(f"{column} exists with type {fields[column]}")
        if any((d.table, d.column, d.deleted) == (table, column, False) for d in self.defs):
            raise DefinitionError(f"{table}.{column} is derived already")
        check_definition(backend, output_type, model, prompt, schema)
        merged = DEFAULTS | (config or {})
        check_config(merged)
        made = Definition(len(self.defs) + 1, table, column, pk, sources, output_type, (Version(1, backend, model, prompt, schema, backend_config or {}),), merged)
        return Catalog((*self.defs, made)), made

    def update_column(self, table: str, column: str, prompt=None, model=None, schema=None, backend_config=None) -> tuple[Catalog, Definition]:
        """A new version; what isn't given stays. The backend and a vector's dimensions can't change."""
        d = self.find(table, column)
        old = d.current
        new = replace(old, number=old.number + 1, prompt=old.prompt if prompt is None else prompt, model=old.model if model is None else model, schema=old.schema if schema is None else schema, backend_config=old.backend_config if backend_config is None else backend_config)
        if replace(new, number=old.number) == old:
            raise DefinitionError("nothing changed")
        check_definition(new.backend, d.output_type, new.model, new.prompt, new.schema)
        if d.output_type in ("vector", "halfvec") and new.schema["dimensions"] != old.schema["dimensions"]:
            raise DefinitionError("the dimensions of a vector can't change")
        d = restarted(replace(d, versions=(*d.versions, new)))
        return self.put(d), d

    def configure(self, table: str, column: str, config: dict) -> tuple[Catalog, dict]:
        d = self.find(table, column)
        merged = d.config | config
        check_config(merged)
        return self.put(replace(d, config=merged)), merged

    def set_enabled(self, table: str, column: str, enabled: bool) -> Catalog:
        d = self.find(table, column)
        return self.put(restarted(replace(d, enabled=True)) if enabled else replace(d, enabled=False))

    def drop_column(self, table: str, column: str) -> Catalog:
        return self.put(replace(self.find(table, column), deleted=True, backfill_pending=False))

    def definition(self, table: str, column: str) -> dict:
        d = self.find(table, column)
        v = d.current
        return {"id": d.def_id, "version": v.number, "backend": v.backend, "model": v.model, "prompt": v.prompt, "output_type": d.output_type, "output_schema": v.schema, "backend_config": v.backend_config, "config": d.config, "enabled": d.enabled}

    def rows(self) -> list[tuple]:
        """One row per definition, for joins (DEF_SCHEMA)."""
        return [
            (d.def_id, d.table, d.column, d.enabled, d.deleted, d.current.number, d.current.backend, d.current.model, float(d.config["confidence_threshold"]), d.config["low_confidence_policy"], int(d.config["max_attempts"]), float(d.config["backoff_base_seconds"]),
             None if d.config["budget_usd"] is None else float(d.config["budget_usd"]), d.config["budget_period"], d.config["lineage_retention_days"], d.backfill_pending, d.backfill_scanned)
            for d in self.defs
        ]

    def to_json(self) -> str:
        return json.dumps([d.__dict__ | {"versions": [v.__dict__ for v in d.versions]} for d in self.defs])

    @staticmethod
    def from_json(text: str) -> Catalog:
        return Catalog(tuple(Definition(**x | {"versions": tuple(Version(**v) for v in x["versions"]), "pk": tuple(x["pk"]), "sources": tuple(x["sources"]), "backfill_cursor": x["backfill_cursor"] and tuple(x["backfill_cursor"])}) for x in json.loads(text)))


DEF_SCHEMA = "def_id long, table_name string, column_name string, enabled boolean, deleted boolean, version int, backend string, model string, threshold double, policy string, max_attempts int, backoff double, budget_usd double, budget_period string, retention_days int, backfill_pending boolean, backfill_scanned long"


def restarted(d: Definition) -> Definition:
    """With its scan of the table back at the start."""
    return replace(d, backfill_pending=True, backfill_scanned=0, backfill_cursor=None, backfill_scan=None)
