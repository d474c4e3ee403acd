"""Checks of an external table's schema against a model."""

from __future__ import annotations

import warnings

from pyspark.sql import types as T

from quern.types import Kind, Product, TypeProblem, spark_type


def differences(found: T.StructType, wanted: T.StructType, path: str = "") -> list[str]:
    """Missing fields, other types, nullable where a value is required, arrays against single values; further fields are fine."""
    out = []
    for w in wanted:
        here = f"{path}.{w.name}".lstrip(".")
        if w.name not in found.names:
            out.append(f"{here}: missing")
            continue
        f = found[w.name]
        if f.nullable and not w.nullable:
            out.append(f"{here}: nullable, but required")
        out += _types(f.dataType, w.dataType, here)
    return out


def _types(found: T.DataType, wanted: T.DataType, path: str) -> list[str]:
    if isinstance(found, T.StructType) and isinstance(wanted, T.StructType):
        return differences(found, wanted, path)
    if isinstance(found, T.ArrayType) and isinstance(wanted, T.ArrayType):
        return _types(found.elementType, wanted.elementType, f"{path}[]")
    if isinstance(found, T.ArrayType) != isinstance(wanted, T.ArrayType):
        return [f"{path}: {'repeated' if isinstance(found, T.ArrayType) else 'single'}, but the model is {'single' if isinstance(found, T.ArrayType) else 'repeated'}"]
    if isinstance(found, T.MapType) and isinstance(wanted, T.MapType):
        return _types(found.keyType, wanted.keyType, f"{path}.key") + _types(found.valueType, wanted.valueType, f"{path}.value")
    return [] if found == wanted else [f"{path}: {found.simpleString()}, but the model has {wanted.simpleString()}"]


def check_schema(found: T.StructType, kind: Kind, mode: str = "strict", nullability: bool = False) -> list[str]:
    """strict raises, warn warns, off does nothing. Files lose NOT NULL, so nullability counts only if asked for."""
    wanted = spark_type(kind) if isinstance(kind, Product) else T.StructType([T.StructField("value", spark_type(kind))])
    problems = [] if mode == "off" else [d for d in differences(found, wanted) if nullability or "nullable" not in d]
    if problems and mode == "strict":
        raise TypeProblem("; ".join(problems))
    if problems:
        warnings.warn("; ".join(problems), stacklevel=2)
    return problems
