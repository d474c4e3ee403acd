"""Models and their schemas.

A model is a dataclass, a tuple type, an enum or a sealed base class of dataclasses; annotations say what each field
holds. Only optional values may be null. An optional value inside an optional one is wrapped in struct<value>, one
wrapper for each extra level, so that "none" and "some none" stay apart.
"""

from __future__ import annotations

import dataclasses
import datetime
import decimal
import enum
import types
import typing
from collections.abc import Callable
from dataclasses import dataclass
from typing import Annotated, Any

from pyspark.sql import types as T


class TypeProblem(TypeError):
    """A model, expression or operator that its types don't allow; raised while a plan is built."""


class NoField(TypeProblem, AttributeError):
    """A field or method that a kind doesn't have."""


@dataclass(frozen=True)
class Kind:
    """What an expression holds."""


@dataclass(frozen=True)
class Scalar(Kind):
    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Dec(Kind):
    precision: int
    scale: int

    def __post_init__(self) -> None:
        if not (1 <= self.precision <= 38 and 0 <= self.scale <= self.precision):
            raise TypeProblem(f"decimal({self.precision},{self.scale}): 1 <= precision <= 38 and 0 <= scale <= precision")

    def __str__(self) -> str:
        return f"decimal({self.precision},{self.scale})"


@dataclass(frozen=True)
class Opt(Kind):
    of: Kind

    def __str__(self) -> str:
        return f"{self.of}?"


@dataclass(frozen=True)
class Seq(Kind):
    of: Kind

    def __str__(self) -> str:
        return f"seq<{self.of}>"


@dataclass(frozen=True)
class Map(Kind):
    key: Kind
    value: Kind

    def __str__(self) -> str:
        return f"map<{self.key},{self.value}>"


@dataclass(frozen=True)
class Product(Kind):
    fields: tuple[tuple[str, Kind], ...]
    cls: Any = dataclasses.field(default=None, compare=False)

    def __str__(self) -> str:
        return "{" + ", ".join(f"{n}: {k}" for n, k in self.fields) + "}"

    def get(self, name: str) -> Kind:
        for n, k in self.fields:
            if n == name:
                return k
        raise TypeProblem(f"no field {name!r} in {self}")

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.fields]


@dataclass(frozen=True)
class Sum(Kind):
    """One of several variants: struct<discriminant, a field for each variant that has fields>."""

    variants: tuple[tuple[str, Product], ...]
    cls: Any = dataclasses.field(default=None, compare=False)

    def __str__(self) -> str:
        return " | ".join(n for n, _ in self.variants)


@dataclass(frozen=True)
class Enum(Kind):
    values: tuple[str, ...]
    cls: Any = dataclasses.field(default=None, compare=False)

    def __str__(self) -> str:
        return "enum(" + ", ".join(self.values) + ")"


BOOL, BYTE, SHORT, INT, LONG, FLOAT, DOUBLE, STRING, BINARY, DATE, TIMESTAMP, DURATION = (Scalar(x) for x in ("boolean", "byte", "short", "int", "long", "float", "double", "string", "binary", "date", "timestamp", "duration"))
Byte, Short, Int, Long = Annotated[int, BYTE], Annotated[int, SHORT], Annotated[int, INT], Annotated[int, LONG]
Float, Double = Annotated[float, FLOAT], Annotated[float, DOUBLE]
INTEGRAL, FLOATING = (BYTE, SHORT, INT, LONG), (FLOAT, DOUBLE)
_SPARK = {"boolean": T.BooleanType(), "byte": T.ByteType(), "short": T.ShortType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "date": T.DateType(), "timestamp": T.TimestampType(), "duration": T.LongType()}
_PYTHON = {bool: BOOL, int: LONG, float: DOUBLE, str: STRING, bytes: BINARY, datetime.date: DATE, datetime.datetime: TIMESTAMP, datetime.timedelta: DURATION}
_VALUES = {"boolean": bool, "byte": int, "short": int, "int": int, "long": int, "float": (float, int), "double": (float, int), "string": str, "binary": (bytes, bytearray), "date": datetime.date, "timestamp": datetime.datetime, "duration": (datetime.timedelta, int)}
#: The one field of a product without fields.
EMPTY = "_empty"


def Decimal(precision: int, scale: int) -> Any:
    """An annotation for a decimal field."""
    return Annotated[decimal.Decimal, Dec(precision, scale)]


def camel(name: str) -> str:
    return name[:1].lower() + name[1:]


def sealed(cls: type) -> type:
    """Mark a base class whose direct subclasses are the variants of a sum."""
    cls.__sealed__ = cls
    return cls


def product(*names: str, **fields: Any) -> Product:
    """A product without a class: tuple fields _1, _2, ... for positional kinds, named ones for keywords."""
    return Product(tuple((n, kind_of(k)) for n, k in fields.items()))


def tuple_of(*kinds: Kind) -> Product:
    return Product(tuple((f"_{i}", k) for i, k in enumerate(kinds, 1)), tuple)


def kind_of(model: Any) -> Kind:
    """The kind of a model, annotation or kind."""
    if isinstance(model, Kind):
        return model
    if model in _PYTHON:
        return _PYTHON[model]
    origin, args = typing.get_origin(model), typing.get_args(model)
    if origin is Annotated:
        for extra in args[1:]:
            if isinstance(extra, Kind):
                return extra
        return kind_of(args[0])
    if origin in (typing.Union, types.UnionType):
        rest = [a for a in args if a is not type(None)]
        if len(rest) == 1 and len(args) == 2:
            return Opt(kind_of(rest[0]))
        raise TypeProblem(f"{model}: a union is an optional value, or a sealed base class")
    if origin in (list, set, frozenset, typing.Sequence):
        return Seq(kind_of(args[0]))
    if origin is dict:
        return Map(kind_of(args[0]), kind_of(args[1]))
    if origin is tuple:
        return tuple_of(*map(kind_of, args))
    if isinstance(model, typing.NewType):
        return kind_of(model.__supertype__)
    if isinstance(model, type) and issubclass(model, enum.Enum):
        return Enum(tuple(camel(m.name) for m in model), model)
    if isinstance(model, type) and model.__dict__.get("__sealed__") is model:
        return Sum(tuple((camel(c.__name__), _fields(c)) for c in model.__subclasses__()), model)
    if dataclasses.is_dataclass(model):
        return _fields(model)
    raise TypeProblem(f"no schema for {model!r}")


def _fields(cls: Any) -> Product:
    if not dataclasses.is_dataclass(cls):
        return Product((), cls)
    hints = typing.get_type_hints(cls, include_extras=True)
    return Product(tuple((f.name, kind_of(hints[f.name])) for f in dataclasses.fields(cls)), cls)


def unwrap(kind: Kind) -> Kind:
    return kind.of if isinstance(kind, Opt) else kind


def is_opt(kind: Kind) -> bool:
    return isinstance(kind, Opt)


def spark_type(kind: Kind) -> T.DataType:
    if isinstance(kind, Scalar):
        return _SPARK[kind.name]
    if isinstance(kind, Dec):
        return T.DecimalType(kind.precision, kind.scale)
    if isinstance(kind, Opt):
        return T.StructType([T.StructField("value", spark_type(kind.of), True)]) if is_opt(kind.of) else spark_type(kind.of)
    if isinstance(kind, Seq):
        return T.ArrayType(spark_type(kind.of), is_opt(kind.of))
    if isinstance(kind, Map):
        return T.MapType(spark_type(kind.key), spark_type(kind.value), is_opt(kind.value))
    if isinstance(kind, Product):
        fields = [T.StructField(n, spark_type(k), is_opt(k)) for n, k in kind.fields]
        return T.StructType(fields or [T.StructField(EMPTY, T.NullType(), True)])
    if isinstance(kind, Sum):
        return T.StructType([T.StructField("discriminant", T.StringType(), False), *(T.StructField(n, spark_type(p), True) for n, p in kind.variants if p.fields)])
    if isinstance(kind, Enum):
        return T.StringType()
    raise TypeProblem(f"no Spark type for {kind}")


def schema(model: Any, metadata: bool = False) -> T.StructType:
    """The table schema of a model: its fields, or one column `value` for what is no product. `metadata` adds dataclass field metadata."""
    kind = kind_of(model)
    if not isinstance(kind, Product):
        return T.StructType([T.StructField("value", spark_type(kind), is_opt(kind))])
    notes = {f.name: dict(f.metadata) for f in dataclasses.fields(kind.cls)} if metadata and dataclasses.is_dataclass(kind.cls) else {}
    return T.StructType([T.StructField(n, spark_type(k), is_opt(k), notes.get(n)) for n, k in kind.fields])


def nullable(data_type: T.DataType) -> T.DataType:
    """The same type with every part nullable."""
    if isinstance(data_type, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType), True) for f in data_type])
    if isinstance(data_type, T.ArrayType):
        return T.ArrayType(nullable(data_type.elementType), True)
    if isinstance(data_type, T.MapType):
        return T.MapType(nullable(data_type.keyType), nullable(data_type.valueType), True)
    return data_type


def cast_type(kind: Kind) -> T.DataType:
    """The Spark type as a cast's target: Spark can't always prove that parts are not null."""
    return nullable(spark_type(kind))


def kind_from_spark(data_type: T.DataType, null: bool = False) -> Kind:
    """The kind of a Spark type; structs become products without a class."""
    names = {v: Scalar(k) for k, v in _SPARK.items() if k != "duration"} | {T.TimestampNTZType(): TIMESTAMP}
    if isinstance(data_type, T.DecimalType):
        kind: Kind = Dec(data_type.precision, data_type.scale)
    elif isinstance(data_type, T.ArrayType):
        kind = Seq(kind_from_spark(data_type.elementType, data_type.containsNull))
    elif isinstance(data_type, T.MapType):
        kind = Map(kind_from_spark(data_type.keyType), kind_from_spark(data_type.valueType, data_type.valueContainsNull))
    elif isinstance(data_type, T.StructType):
        kind = Product(tuple((f.name, kind_from_spark(f.dataType, f.nullable)) for f in data_type))
    elif data_type in names:
        kind = names[data_type]
    else:
        raise TypeProblem(f"no kind for {data_type.simpleString()}")
    return Opt(kind) if null else kind


def _parts(kind: Kind) -> list[Kind]:
    if isinstance(kind, (Opt, Seq)):
        return [kind.of]
    if isinstance(kind, Map):
        return [kind.key, kind.value]
    if isinstance(kind, Product):
        return [k for _, k in kind.fields]
    return [p for _, p in kind.variants] if isinstance(kind, Sum) else []


def groupable(kind: Kind) -> bool:
    """Whether values can be grouped and compared for equality: nothing with a map inside."""
    return not isinstance(kind, Map) and all(map(groupable, _parts(kind)))


def orderable(kind: Kind) -> bool:
    """Whether values can be sorted: no sequences, maps, binaries or durations."""
    return not isinstance(kind, (Seq, Map)) and kind not in (BINARY, DURATION) and all(map(orderable, _parts(kind)))


def comparable(kind: Kind) -> bool:
    """Whether < and the like, min and max apply."""
    return (isinstance(kind, Scalar) and kind != BINARY) or isinstance(kind, (Dec, Enum))


def require(ok: bool, what: str) -> None:
    if not ok:
        raise TypeProblem(what)


def sum_kind(kind: Kind) -> Kind:
    """What a sum of values is: integers give long, floats double, decimals of 38 digits themselves."""
    base = unwrap(kind)
    if base in INTEGRAL:
        out: Kind = LONG
    elif base in FLOATING:
        out = DOUBLE
    elif isinstance(base, Dec) and base.precision == 38:
        out = base
    else:
        raise TypeProblem(f"no sum of {kind}; cast decimals to 38 digits first")
    return Opt(out) if is_opt(kind) else out


def project_kind(kind: Product, to: Product) -> None:
    """Fail unless every field of `to` is in `kind` with the same kind."""
    for n, k in to.fields:
        require(kind.get(n) == k, f"field {n!r} is {kind.get(n)}, not {k}")


def field_of_kind(kind: Product, wanted: Kind) -> str:
    found = [n for n, k in kind.fields if k == wanted]
    require(len(found) == 1, f"{len(found)} fields of {wanted} in {kind}")
    return found[0]


# --- Python values -------------------------------------------------------------------------------------------------

EPOCH = datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)


def encode(kind: Kind, value: Any) -> Any:
    """A Python value as Spark takes it."""
    if isinstance(kind, Opt):
        if value is None:
            return None
        if is_opt(kind.of):
            return {"value": encode(kind.of, value.value if isinstance(value, Some) else value)}
        return encode(kind.of, value.value if isinstance(value, Some) else value)
    require(value is not None, f"null for {kind}; only optional values may be null")
    if isinstance(kind, Seq):
        return [encode(kind.of, x) for x in value]
    if isinstance(kind, Map):
        return {_hashable(encode(kind.key, k)): encode(kind.value, v) for k, v in value.items()}
    if isinstance(kind, Product):
        get: Callable = (lambda n, i: value[i]) if isinstance(value, (tuple, list)) else (lambda n, i: value[n]) if isinstance(value, dict) else (lambda n, i: getattr(value, n))
        return tuple(encode(k, get(n, i)) for i, (n, k) in enumerate(kind.fields)) or (None,)
    if isinstance(kind, Sum):
        name = camel(type(value).__name__)
        return (name, *(encode(p, value) if n == name else None for n, p in kind.variants if p.fields))
    if isinstance(kind, Enum):
        return camel(value.name) if isinstance(value, enum.Enum) else value
    if isinstance(kind, (Scalar, Dec)):
        allowed = decimal.Decimal if isinstance(kind, Dec) else _VALUES[kind.name]
        require(isinstance(value, allowed) and (isinstance(value, bool) == (kind == BOOL)), f"{value!r} is no {kind}")
        if kind in INTEGRAL:
            bits = (7, 15, 31, 63)[INTEGRAL.index(kind)]
            require(-(2**bits) <= value < 2**bits, f"{value} doesn't fit {kind}")
    if kind == DURATION and isinstance(value, datetime.timedelta):
        return value // datetime.timedelta(microseconds=1)
    if kind == TIMESTAMP and isinstance(value, datetime.datetime) and value.tzinfo is None:
        return value.replace(tzinfo=datetime.UTC)
    return float(value) if kind in FLOATING else value


def _hashable(value: Any) -> Any:
    return tuple(map(_hashable, value)) if isinstance(value, list) else value


def assemble(kind: Product, parts: list[Any]) -> Any:
    """A product's own Python value: an object, a tuple, or a dict where there is no class."""
    if dataclasses.is_dataclass(kind.cls):
        return kind.cls(*parts)
    if kind.cls is tuple or (kind.fields and kind.fields[0][0] == "_1"):
        return tuple(parts)
    return kind.cls() if kind.cls else dict(zip(kind.names, parts, strict=True))


def decode(kind: Kind, value: Any) -> Any:
    """A value that Spark gave, as the model's own."""
    if isinstance(kind, Opt):
        if value is None:
            return None
        return Some(decode(kind.of, value["value"])) if is_opt(kind.of) else decode(kind.of, value)
    require(value is not None, f"null for {kind}; only optional values may be null")
    if isinstance(kind, Seq):
        return [decode(kind.of, x) for x in value]
    if isinstance(kind, Map):
        return {decode(kind.key, k): decode(kind.value, v) for k, v in value.items()}
    if isinstance(kind, Product):
        return assemble(kind, [decode(k, value[i]) for i, (_, k) in enumerate(kind.fields)])
    if isinstance(kind, Sum):
        variant = dict(kind.variants).get(value["discriminant"])
        require(variant is not None, f"no variant {value['discriminant']!r} of {kind}")
        if not variant.fields:
            return variant.cls()
        own = value[value["discriminant"]]
        return decode(variant, own if own is not None else [None] * len(variant.fields))
    if isinstance(kind, Enum):
        require(value in kind.values, f"{value!r} is not in {kind}")
        return next((m for m in kind.cls if camel(m.name) == value), value) if kind.cls else value
    return datetime.timedelta(microseconds=value) if kind == DURATION else value


@dataclass(frozen=True)
class Some:
    """A present value where a plain one would be ambiguous: Some(None) in an optional optional."""

    value: Any
