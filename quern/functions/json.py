"""JSON text of typed values, strict both ways.

Maps are arrays of {key, value}, durations integer microseconds, decimals strings, binaries base64; a value that is no
object or array at the top is refused. Reading goes through an all-nullable schema with numbers as text, so what doesn't
fit is seen: a whole value with any missing or malformed required part is null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.expr import E
from quern.types import DURATION, EMPTY, INTEGRAL, STRING, Dec, Enum, Kind, Map, Opt, Product, Seq, Sum, cast_type, is_opt, kind_of, nullable, require

OPTIONS = {"timeZone": "UTC", "timestampFormat": "yyyy-MM-dd'T'HH:mm[:ss][.SSSSSS][XXX]"}
#: Writing needs a format without optional parts.
WRITE_OPTIONS = OPTIONS | {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def _plain(kind: Kind) -> bool:
    """Whether values are written as Spark does anyway."""
    if isinstance(kind, (Opt, Seq)):
        return _plain(kind.of)
    if isinstance(kind, (Product, Sum)):
        return all(_plain(k) for _, k in (kind.fields if isinstance(kind, Product) else kind.variants))
    return not isinstance(kind, (Map, Dec))


def outward(kind: Kind, col: Column) -> Column:
    """A value in the form that goes to JSON."""
    if _plain(kind):
        return col
    if isinstance(kind, Opt):
        return F.when(col.isNotNull(), F.struct(outward(kind.of, col["value"]).alias("value")) if is_opt(kind.of) else outward(kind.of, col))
    if isinstance(kind, Seq):
        return F.transform(col, lambda x: outward(kind.of, x))
    if isinstance(kind, Map):
        return F.transform(F.map_entries(col), lambda e: F.struct(outward(kind.key, e["key"]).alias("key"), outward(kind.value, e["value"]).alias("value")))
    if isinstance(kind, Product):
        return F.struct(*(outward(k, col[n]).alias(n) for n, k in kind.fields))
    if isinstance(kind, Sum):
        return F.struct(col["discriminant"].alias("discriminant"), *(F.when(col[n].isNotNull(), outward(p, col[n])).alias(n) for n, p in kind.variants if p.fields))
    return col.cast("string")


def wire_type(kind: Kind) -> T.DataType:
    """What is asked of the JSON reader: numbers that must be exact as text, maps as arrays."""
    if isinstance(kind, Opt):
        return T.StructType([T.StructField("value", wire_type(kind.of))]) if is_opt(kind.of) else wire_type(kind.of)
    if isinstance(kind, Seq):
        return T.ArrayType(wire_type(kind.of))
    if isinstance(kind, Map):
        return T.ArrayType(T.StructType([T.StructField("key", wire_type(kind.key)), T.StructField("value", wire_type(kind.value))]))
    if isinstance(kind, Product):
        return T.StructType([T.StructField(n, wire_type(k)) for n, k in kind.fields] or [T.StructField(EMPTY, T.StringType())])
    if isinstance(kind, Sum):
        return T.StructType([T.StructField("discriminant", T.StringType()), *(T.StructField(n, wire_type(p)) for n, p in kind.variants if p.fields)])
    return T.StringType() if kind in INTEGRAL or kind == DURATION or isinstance(kind, Dec) else cast_type(kind)


def inward(kind: Kind, col: Column) -> Column:
    """The typed value of what the reader gave; null parts where something is missing or malformed."""
    if kind in INTEGRAL or kind == DURATION:
        return F.when(col.rlike(r"^[+-]?[0-9]+$"), col.try_cast(cast_type(kind)))
    if isinstance(kind, Dec):
        return col.try_cast(cast_type(kind))
    if isinstance(kind, Opt):
        return F.when(col.isNotNull(), F.struct(inward(kind.of, col["value"]).alias("value"))) if is_opt(kind.of) else inward(kind.of, col)
    if isinstance(kind, Seq):
        return F.transform(col, lambda x: inward(kind.of, x))
    if isinstance(kind, Map):
        return F.map_from_entries(F.transform(col, lambda e: F.struct(inward(kind.key, e["key"]).alias("key"), inward(kind.value, e["value"]).alias("value"))))
    if isinstance(kind, Product):
        return F.when(col.isNotNull(), F.struct(*(inward(k, col[n]).alias(n) for n, k in kind.fields)) if kind.fields else F.struct(F.lit(None).alias(EMPTY)))
    if isinstance(kind, Sum):
        return F.when(col.isNotNull(), F.struct(col["discriminant"].alias("discriminant"), *(inward(p, col[n]).alias(n) for n, p in kind.variants if p.fields)))
    return col


def sound(kind: Kind, col: Column) -> Column:
    """Whether what the reader gave is a whole value of the kind."""
    if isinstance(kind, Opt):
        return col.isNull() | sound(kind.of, col["value"] if is_opt(kind.of) else col)
    there = col.isNotNull()
    if isinstance(kind, Seq):
        return there & F.coalesce(F.forall(col, lambda x: sound(kind.of, x)), F.lit(False))
    if isinstance(kind, Map):
        whole = F.coalesce(F.forall(col, lambda e: e.isNotNull() & sound(kind.key, e["key"]) & sound(kind.value, e["value"])), F.lit(False))
        return there & whole & F.coalesce(F.size(F.array_distinct(F.transform(col, lambda e: e["key"]))) == F.size(col), F.lit(False))
    if isinstance(kind, Product):
        return _all([there, *(sound(k, col[n]) for n, k in kind.fields)])
    if isinstance(kind, Sum):
        out = F.lit(False)
        for n, p in kind.variants:
            free = all(is_opt(k) for _, k in p.fields)
            payload = F.lit(True) if not p.fields else (col[n].isNull() | sound(p, col[n])) if free else sound(p, col[n])
            out = out | (F.coalesce(col["discriminant"] == n, F.lit(False)) & payload)
        return there & out
    if isinstance(kind, Enum):
        return there & F.coalesce(col.isin(*kind.values), F.lit(False))
    return there & inward(kind, col).isNotNull()


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _top(kind: Kind) -> None:
    require(isinstance(kind, (Product, Sum, Seq, Map)), f"{kind} is no JSON object or array")


def to_json(e: E) -> E:
    _top(e.kind)
    return E(STRING, F.to_json(outward(e.kind, e.col), WRITE_OPTIONS), agg=e.agg)


def from_json(e: E, model: object) -> E:
    """The value of a JSON text, or nothing where it isn't one of the model."""
    kind = kind_of(model)
    _top(kind)
    require(e.kind == STRING, f"{e.kind} is no text")
    parsed = F.from_json(e.col, wire_type(kind), OPTIONS | {"mode": "PERMISSIVE"})
    checked: Callable[[Column], Column] = lambda p: F.when(sound(kind, p), inward(kind, p))
    return E(Opt(kind), F.element_at(F.transform(F.array(parsed), checked), 1), agg=e.agg)  # parsed once, as a lambda's argument
