"""Table definitions and JSON Schemas of models."""

from __future__ import annotations

from typing import Any

from quern.types import BINARY, BOOL, BYTE, DATE, DOUBLE, DURATION, FLOAT, INT, LONG, SHORT, STRING, TIMESTAMP, Dec, Enum, Kind, Map, Opt, Product, Seq, Sum, is_opt, kind_of

_SQL = {BOOL: "BOOLEAN", BYTE: "TINYINT", SHORT: "SMALLINT", INT: "INT", LONG: "BIGINT", FLOAT: "FLOAT", DOUBLE: "DOUBLE", STRING: "STRING", BINARY: "BINARY", DATE: "DATE", TIMESTAMP: "TIMESTAMP", DURATION: "BIGINT"}
_INT_BOUNDS = {BYTE: 7, SHORT: 15, INT: 31, LONG: 63}


def sql_type(kind: Kind) -> str:
    if isinstance(kind, Opt):
        return f"STRUCT<value: {sql_type(kind.of)}>" if is_opt(kind.of) else sql_type(kind.of)
    if isinstance(kind, Dec):
        return f"DECIMAL({kind.precision}, {kind.scale})"
    if isinstance(kind, Seq):
        return f"ARRAY<{sql_type(kind.of)}>"
    if isinstance(kind, Map):
        return f"MAP<{sql_type(kind.key)}, {sql_type(kind.value)}>"
    if isinstance(kind, Product):
        return "STRUCT<" + ", ".join(f"{_name(n)}: {sql_type(k)}{'' if is_opt(k) else ' NOT NULL'}" for n, k in kind.fields) + ">"
    if isinstance(kind, Sum):
        return "STRUCT<" + ", ".join(["discriminant: STRING NOT NULL", *(f"{_name(n)}: {sql_type(p)}" for n, p in kind.variants if p.fields)]) + ">"
    return "STRING" if isinstance(kind, Enum) else _SQL[kind]


def _name(n: str) -> str:
    return n if n.isidentifier() and n.isascii() else "`" + n.replace("`", "``") + "`"


def to_ddl(model: Any, pretty: bool = False) -> str:
    """Columns of a table: NOT NULL where a value is required, and the values of enums as a comment."""
    kind = kind_of(model)
    fields = kind.fields if isinstance(kind, Product) else (("value", kind),)

    def line(n: str, k: Kind) -> str:
        inner = k.of if isinstance(k, Opt) else k
        note = f" COMMENT '{', '.join(inner.values)}'" if isinstance(inner, Enum) else ""
        return f"{_name(n)} {sql_type(k)}{'' if is_opt(k) else ' NOT NULL'}{note}"

    return (",\n" if pretty else ", ").join(("  " if pretty else "") + line(n, k) for n, k in fields)


def to_json_schema(model: Any) -> dict[str, Any]:
    """A JSON Schema of the wire form."""
    return {"$schema": "https://json-schema.org/draft/2020-12/schema"} | _json(kind_of(model))


def _json(kind: Kind) -> dict[str, Any]:
    if isinstance(kind, Opt):
        inner = _object({"value": _json(kind.of)}, []) if is_opt(kind.of) else _json(kind.of)
        return {"anyOf": [inner, {"type": "null"}]}
    if isinstance(kind, Seq):
        return {"type": "array", "items": _json(kind.of)}
    if isinstance(kind, Map):
        return {"type": "array", "items": _object({"key": _json(kind.key), "value": _json(kind.value)}, ["key"] if is_opt(kind.value) else ["key", "value"])}
    if isinstance(kind, Product):
        return _object({n: _json(k) for n, k in kind.fields}, [n for n, k in kind.fields if not is_opt(k)])
    if isinstance(kind, Sum):
        return {"oneOf": [_object({"discriminant": {"const": n}} | ({n: _json(p)} if p.fields else {}), ["discriminant", *([n] if any(not is_opt(k) for _, k in p.fields) else [])]) for n, p in kind.variants]}
    if isinstance(kind, Enum):
        return {"type": "string", "enum": list(kind.values)}
    if isinstance(kind, Dec):
        return {"type": ["string", "number"]}
    if kind in _INT_BOUNDS:
        bits = _INT_BOUNDS[kind]
        return {"type": "integer", "minimum": -(2**bits), "maximum": 2**bits - 1}
    if kind == DURATION:
        return {"type": "integer"}
    if kind in (FLOAT, DOUBLE):
        return {"anyOf": [{"type": "number"}, {"enum": ["NaN", "Infinity", "-Infinity"]}]}
    formats = {BINARY: {"contentEncoding": "base64"}, DATE: {"format": "date"}, TIMESTAMP: {"format": "date-time"}}
    return {"type": "boolean"} if kind == BOOL else {"type": "string"} | formats.get(kind, {})


def _object(properties: dict[str, Any], required: list[str]) -> dict[str, Any]:
    return {"type": "object", "properties": properties, "required": required}
