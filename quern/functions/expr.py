"""Typed expressions: a Spark column with its kind, checked while the plan is built.

A product stays a set of columns until something needs it as one value, so joins and aggregations see flat columns. An
optional product that an outer join made carries a column that says whether the row is present: a matched row of nulls
is not a missing row.
"""

from __future__ import annotations

import datetime
import decimal
import functools
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.types import (
    BINARY,
    BOOL,
    DATE,
    DOUBLE,
    DURATION,
    EMPTY,
    EPOCH,
    FLOAT,
    FLOATING,
    INT,
    INTEGRAL,
    LONG,
    STRING,
    TIMESTAMP,
    Dec,
    Enum,
    Kind,
    Map,
    NoField,
    Opt,
    Product,
    Seq,
    Some,
    Sum,
    TypeProblem,
    comparable,
    encode,
    field_of_kind,
    groupable,
    is_opt,
    kind_from_spark,
    kind_of,
    project_kind,
    require,
    cast_type,
    tuple_of,
    unwrap,
)


#: What has a meaning in a pattern.
_SPECIAL = set("\\.[]{}()*+?^$|")


class E:
    """An expression. `e.name` or `e["name"]` is a field of a product; methods depend on the kind."""

    __hash__ = None  # type: ignore[assignment]

    def __init__(self, kind: Kind, col: Column | None = None, parts: dict[str, E] | None = None, present: Column | None = None, agg: bool = False):
        self.kind, self._col, self.parts, self.present = kind, col, parts, present
        self.agg = agg or any(p.agg for p in (parts or {}).values())

    # --- shape -----------------------------------------------------------------------------------------------------

    @property
    def col(self) -> Column:
        """One column that holds the value."""
        if self._col is None:
            cols = [p.col.alias(n) for n, p in self.parts.items()] or [F.lit(None).alias(EMPTY)]
            struct = F.struct(*cols)
            self._col = struct if self.present is None else F.when(self.present, struct)
        return self._col

    def leaves(self, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], Kind, Column]]:
        """The flat columns that the value lives in, with their places."""
        if self.parts is not None:
            if self.present is not None:
                yield (*path, "?"), BOOL, self.present
            for n, p in self.parts.items():
                yield from p.leaves((*path, n))
        else:
            yield path, self.kind, self.col

    def rebuilt(self, take: Callable[[tuple[str, ...]], Column], path: tuple[str, ...] = ()) -> E:
        """The same shape over other columns."""
        if self.parts is None:
            return E(self.kind, take(path))
        return E(self.kind, None, {n: p.rebuilt(take, (*path, n)) for n, p in self.parts.items()}, None if self.present is None else take((*path, "?")))

    def opened(self) -> E:
        """A product as its parts."""
        if self.parts is None and isinstance(self.kind, Product):
            return E(self.kind, self._col, {n: E(k, self._col[n], agg=self.agg) for n, k in self.kind.fields}, agg=self.agg)
        return self

    def _product(self) -> Product:
        require(isinstance(self.kind, Product), f"{self.kind} has no fields; use map on an optional value")
        return self.kind

    def __getitem__(self, name: str) -> E:
        kind = self._product().get(name)
        return self.parts[name] if self.parts is not None else E(kind, self._col[name], agg=self.agg)

    def __getattr__(self, name: str) -> E:
        if name.startswith("__") or "kind" not in self.__dict__:
            raise AttributeError(name)
        if isinstance(self.kind, Product) and name in self.kind.names:
            return self[name]
        raise NoField(f"no field or method {name!r} on {self.kind}")

    def _like(self, kind: Kind, col: Column, *others: E) -> E:
        return E(kind, col, agg=self.agg or any(o.agg for o in others))

    # --- equality, order, booleans -----------------------------------------------------------------------------------

    def _other(self, value: Any) -> E:
        return value if isinstance(value, E) else lit(value, self.kind)

    def __eq__(self, value: Any) -> E:  # type: ignore[override]
        if value is None:
            require(is_opt(self.kind), f"{self.kind} is never null")
            return self.is_empty()
        other = self._other(value)
        require(self.kind == other.kind, f"{self.kind} == {other.kind}; use contains for an optional value")
        require(groupable(self.kind), f"no equality for {self.kind}")
        if self.parts is not None and other.parts is not None and self.present is None and other.present is None and self.parts:
            return functools.reduce(lambda a, b: a & b, (self.parts[n] == other.parts[n] for n in self.parts))
        return self._like(BOOL, self.col.eqNullSafe(other.col) if is_opt(self.kind) else self.col == other.col, other)

    def __ne__(self, value: Any) -> E:  # type: ignore[override]
        return ~(self == value)

    def _compare(self, value: Any, how: Callable[[Column, Column], Column]) -> E:
        other = self._other(value)
        require(self.kind == other.kind and comparable(self.kind), f"no order between {self.kind} and {other.kind}")
        return self._like(BOOL, how(self.col, other.col), other)

    def __lt__(self, value: Any) -> E:
        return self._compare(value, lambda a, b: a < b)

    def __le__(self, value: Any) -> E:
        return self._compare(value, lambda a, b: a <= b)

    def __gt__(self, value: Any) -> E:
        return self._compare(value, lambda a, b: a > b)

    def __ge__(self, value: Any) -> E:
        return self._compare(value, lambda a, b: a >= b)

    def _boolean(self, value: Any, how: Callable[[Column, Column], Column]) -> E:
        other = self._other(value)
        require(self.kind == BOOL and other.kind == BOOL, f"{self.kind} and {other.kind} are no booleans")
        return self._like(BOOL, how(self.col, other.col), other)

    def __and__(self, value: Any) -> E:
        return self._boolean(value, lambda a, b: a & b)

    def __or__(self, value: Any) -> E:
        return self._boolean(value, lambda a, b: a | b)

    def __invert__(self) -> E:
        require(self.kind == BOOL, f"{self.kind} is no boolean")
        return self._like(BOOL, ~self.col)

    def __bool__(self) -> bool:
        raise TypeProblem("an expression has no truth value; use & | ~ instead of and, or, not")

    # --- numbers and casts -------------------------------------------------------------------------------------------

    def __add__(self, value: Any) -> E:
        other = self._other(value)
        require(self.kind == other.kind and self.kind in (INT, LONG, FLOAT, DOUBLE), f"no + for {self.kind} and {other.kind}")
        return self._like(self.kind, self.col + other.col, other)

    def __floordiv__(self, value: Any) -> E:
        """Truncating integer division; a division by zero is an error."""
        other = self._other(value)
        require(self.kind == other.kind and self.kind in INTEGRAL, f"no integer division of {self.kind} by {other.kind}")
        quotient = F.call_function("div", self.col.cast("long"), other.col.cast("long"))
        return self._like(self.kind, quotient.cast(cast_type(self.kind)), other)

    def is_nan(self) -> E:
        require(self.kind in FLOATING, f"{self.kind} is never NaN")
        return self._like(BOOL, F.isnan(self.col))

    def cast(self, to: Any) -> E:
        """A cast that can't fail; anything else is refused."""
        to = kind_of(to)
        if isinstance(self.kind, Opt):
            return self.map(lambda x: x.cast(unwrap(to)))
        if isinstance(self.kind, Seq):
            require(isinstance(to, Seq), f"no cast from {self.kind} to {to}")
            return self.map(lambda x: x.cast(to.of))
        require(can_cast(self.kind, to), f"no safe cast from {self.kind} to {to}; try_cast may give null")
        return self._like(to, F.encode(self.col, "utf-8") if to == BINARY else self.col.cast(cast_type(to)))

    def try_cast(self, to: Any) -> E:
        """A cast that gives null where the value doesn't fit."""
        to = kind_of(to)
        source = unwrap(self.kind)
        if can_cast(source, to):
            return some(self.cast(to)) if not is_opt(self.kind) else self.map(lambda x: x.cast(to))
        require(can_try_cast(source, to), f"no cast from {self.kind} to {to}")
        col, type_ = self.col, cast_type(to)
        if source == STRING:
            fits = col.rlike(r"^ *[+-]?[0-9]+ *$")  # ASCII digits only; blanks around them, no control characters
            col = F.when(fits, F.trim(col).try_cast(type_))
        elif isinstance(source, Dec) and to == LONG:
            col = F.round(col, 0).try_cast(type_)
        else:
            col = col.try_cast(type_)
        return self._like(Opt(to), col)

    def to_micros(self) -> E:
        if self.kind == DURATION:
            return self._like(LONG, self.col)
        require(self.kind == TIMESTAMP, f"no microseconds of {self.kind}")
        return self._like(LONG, F.unix_micros(self.col))

    def to_days(self) -> E:
        require(self.kind == DATE, f"no days of {self.kind}")
        return self._like(INT, F.unix_date(self.col))

    # --- optional values ---------------------------------------------------------------------------------------------

    def _optional(self) -> Opt:
        require(is_opt(self.kind), f"{self.kind} is not optional")
        return self.kind

    def is_empty(self) -> E:
        self._optional()
        return E(BOOL, ~self.present if self.present is not None else self.col.isNull(), agg=self.agg)

    def _inner(self) -> E:
        """The value inside, valid where there is one."""
        kind = self._optional().of
        if self.parts is not None:
            return E(kind, None, self.parts, agg=self.agg)
        return E(kind, self.col["value"] if is_opt(kind) else self.col, agg=self.agg)

    def _where_present(self, value: E) -> Column:
        return F.when(~self.is_empty().col, value.col)

    def map(self, f: Callable[[E], E]) -> E:
        """On an optional value or a sequence."""
        if isinstance(self.kind, Seq):
            return self._each(F.transform, f, lambda k: Seq(k))
        inner = f(self._inner())
        return self._like(Opt(inner.kind), self._where_present(_boxed(inner)), inner)

    def flat_map(self, f: Callable[[E], E]) -> E:
        """On an optional value f gives another; on a sequence f gives a sequence or an optional value."""
        if isinstance(self.kind, Seq):
            out = self.map(f)
            if isinstance(out.kind.of, Opt):
                present = F.filter(out.col, lambda x: x.isNotNull())
                return self._like(Seq(out.kind.of.of), F.transform(present, lambda x: x["value"]) if is_opt(out.kind.of.of) else present)
            return out.flatten()
        inner = f(self._inner())
        require(is_opt(inner.kind), "flat_map needs an optional value")
        return self._like(inner.kind, self._where_present(inner), inner)

    def filter(self, f: Callable[[E], E]) -> E:
        if isinstance(self.kind, Seq):
            return E(self.kind, F.filter(self.col, lambda x: _condition(f(E(self.kind.of, x)))), agg=self.agg)
        test = f(self._inner())
        return self._like(self.kind, F.when(~self.is_empty().col & _condition(test), self.col), test)

    def zip(self, other: E) -> E:
        """Both values where both are present; sequences up to the shorter one."""
        if isinstance(self.kind, Seq):
            a, b = self.col, other.col
            both = F.transform(F.sequence(F.lit(0), F.least(F.size(a), F.size(b)) - 1), lambda i: F.struct(F.get(a, i).alias("_1"), F.get(b, i).alias("_2")))
            some_ = (F.size(a) > 0) & (F.size(b) > 0)
            kind = Seq(tuple_of(self.kind.of, other.kind.of))
            return self._like(kind, F.when(some_, both).otherwise(F.array().cast(cast_type(kind))), other)
        return self.flat_map(lambda x: other.map(lambda y: tuple_(x, y)))

    def exists(self, f: Callable[[E], E]) -> E:
        """False on no value."""
        if isinstance(self.kind, Seq):
            return E(BOOL, F.exists(self.col, lambda x: _condition(f(E(self.kind.of, x)))), agg=self.agg)
        test = f(self._inner())
        return self._like(BOOL, ~self.is_empty().col & _condition(test), test)

    def forall(self, f: Callable[[E], E]) -> E:
        """True on no value."""
        if isinstance(self.kind, Seq):
            return E(BOOL, F.forall(self.col, lambda x: _condition(f(E(self.kind.of, x)))), agg=self.agg)
        test = f(self._inner())
        return self._like(BOOL, self.is_empty().col | _condition(test), test)

    def contains(self, value: Any) -> E:
        """Whether an optional value is there and equal, or a sequence has an equal one."""
        of = self.kind.of if isinstance(self.kind, (Opt, Seq)) else None
        require(of is not None, f"no contains on {self.kind}")
        item = value if isinstance(value, E) else lit(value, of)
        return self.exists(lambda x: x == item)

    def or_else(self, other: E) -> E:
        return coalesce(self, other)

    def get_or_else(self, value: Any) -> E:
        inner = self._inner()
        other = value if isinstance(value, E) else lit(value, inner.kind)
        require(other.kind == inner.kind, f"{other.kind} in place of {inner.kind}")
        if is_opt(inner.kind):
            return self._like(inner.kind, F.when(~self.is_empty().col, inner.col).otherwise(other.col), other)
        return self._like(inner.kind, F.coalesce(self.col, other.col), other)

    def expect(self, message: str) -> E:
        """The value; an error with the message where there is none."""
        return self.get_or_else(raise_error(message, self._optional().of))

    def spread_option(self) -> E:
        """An optional product as a product of optional fields."""
        inner = self._inner().opened()
        require(isinstance(inner.kind, Product), f"{self.kind} is no optional product")
        parts = {n: (E(p.kind, self._where_present(p)) if is_opt(p.kind) else E(Opt(p.kind), self._where_present(p))) for n, p in inner.parts.items()}
        return E(Product(tuple((n, p.kind) for n, p in parts.items())), None, parts, agg=self.agg)

    # --- strings and bytes -------------------------------------------------------------------------------------------

    def _text(self, value: Any = "") -> Column:
        other = value if isinstance(value, E) else lit(value, STRING)
        require(self.kind == STRING and other.kind == STRING, f"{self.kind} is no string")
        return other.col

    def starts_with(self, value: Any) -> E:
        return self._like(BOOL, F.startswith(self.col, self._text(value)))

    def ends_with(self, value: Any) -> E:
        return self._like(BOOL, F.endswith(self.col, self._text(value)))

    def trim(self) -> E:
        """Without U+0020 at both ends."""
        self._text()
        return self._like(STRING, F.trim(self.col))

    def split(self, delimiter: Any) -> E:
        """By a literal delimiter; trailing empty parts stay. An empty one gives the characters and an empty string."""
        text = self._text(delimiter)
        if isinstance(delimiter, str) and delimiter:
            return self._like(Seq(STRING), F.split(self.col, "".join("\\" + c if c in _SPECIAL else c for c in delimiter), -1))
        plain = F.regexp_replace(text, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
        return self._like(Seq(STRING), F.split(self.col, F.when(F.length(plain) > 0, plain).otherwise("(?:)"), -1))

    def concat(self, *others: Any) -> E:
        """Strings, or sequences of the same kind."""
        more = [o if isinstance(o, E) else lit(o, self.kind) for o in others]
        require(isinstance(self.kind, Seq) or self.kind == STRING, f"no concat on {self.kind}")
        require(all(o.kind == self.kind for o in more), f"concat needs {self.kind} throughout")
        return self._like(self.kind, F.concat(self.col, *(o.col for o in more)), *more)

    def to_base64(self) -> E:
        require(self.kind == BINARY, f"{self.kind} is no binary")
        return self._like(STRING, F.replace(F.base64(self.col), F.lit("\r\n"), F.lit("")))

    def from_base64(self) -> E:
        """Null where the text is no base64."""
        self._text()
        return self._like(Opt(BINARY), F.try_to_binary(self.col, F.lit("base64")))

    def length(self) -> E:
        require(self.kind == BINARY, f"{self.kind} is no binary")
        return self._like(INT, F.length(self.col))

    # --- sequences and maps ------------------------------------------------------------------------------------------

    def _seq(self) -> Kind:
        require(isinstance(self.kind, Seq), f"{self.kind} is no sequence")
        return self.kind.of

    def _each(self, how: Callable, f: Callable[[E], E], kind: Callable[[Kind], Kind]) -> E:
        seen: list[E] = []

        def body(x: Column) -> Column:
            seen.append(f(E(self._seq(), x)))
            return seen[-1].col

        col = how(self.col, body)
        return self._like(kind(seen[-1].kind), col)

    def size(self) -> E:
        require(isinstance(self.kind, (Seq, Map)), f"no size of {self.kind}")
        return self._like(INT, F.size(self.col))

    def get(self, index: Any) -> E:
        """An element by its place from 0, an error outside; on a map the value of a key, if any."""
        if isinstance(self.kind, Map):
            key = index if isinstance(index, E) else lit(index, self.kind.key)
            require(key.kind == self.kind.key, f"{key.kind} is no key of {self.kind}")
            value = F.try_element_at(self.col, key.col)
            if is_opt(self.kind.value):
                value = F.when(F.map_contains_key(self.col, key.col), F.struct(value.alias("value")))
            return self._like(Opt(self.kind.value), value, key)
        place = index if isinstance(index, E) else lit(index, INT)
        checked = F.when(place.col < 0, F.raise_error(F.lit("negative index")).cast("int")).otherwise(place.col)
        return self._like(self._seq(), F.element_at(self.col, checked + 1), place)

    def flatten(self) -> E:
        require(isinstance(self._seq(), Seq), f"{self.kind} holds no sequences")
        return self._like(self.kind.of, F.flatten(self.col))

    def distinct(self) -> E:
        require(groupable(self._seq()), f"no equality for {self.kind.of}")
        return self._like(self.kind, F.array_distinct(self.col))

    def mk_string(self, separator: Any = "") -> E:
        require(self._seq() == STRING, f"{self.kind} holds no strings")
        other = separator if isinstance(separator, E) else lit(separator, STRING)
        return self._like(STRING, F.call_function("array_join", self.col, other.col), other)

    def to_map(self) -> E:
        """From a sequence of pairs; a key that occurs twice is an error."""
        of = self._seq()
        require(isinstance(of, Product) and len(of.fields) == 2, f"{of} is no pair")
        (_, key), (_, value) = of.fields
        require(groupable(key) and not is_opt(key), f"{key} can't be a key")
        return self._like(Map(key, value), F.map_from_entries(self.col))

    def entries(self) -> E:
        require(isinstance(self.kind, Map), f"{self.kind} is no map")
        kind = Seq(tuple_of(self.kind.key, self.kind.value))
        return self._like(kind, F.transform(F.map_entries(self.col), lambda e: F.struct(e["key"].alias("_1"), e["value"].alias("_2"))))

    # --- products ----------------------------------------------------------------------------------------------------

    def _made(self, parts: dict[str, E], cls: Any = None) -> E:
        return E(Product(tuple((n, p.kind) for n, p in parts.items()), cls), None, parts, agg=self.agg)

    def project(self, model: Any) -> E:
        """Only the fields of another model, by name."""
        to = kind_of(model)
        project_kind(self._product(), to)
        return E(to, None, {n: self[n] for n, _ in to.fields}, agg=self.agg)

    def as_(self, model: Any) -> E:
        """The same fields as another model."""
        to = kind_of(model)
        require(sorted(self._product().names) == sorted(to.names), f"{self.kind} has other fields than {to}")
        return self.project(to)

    def copy(self, **fields: Any) -> E:
        """With some fields replaced by values of the same kind."""
        new = {n: v if isinstance(v, E) else lit(v, self._product().get(n)) for n, v in fields.items()}
        for n, v in new.items():
            require(v.kind == self.kind.get(n), f"field {n!r} is {self.kind.get(n)}, not {v.kind}")
        return E(self.kind, None, {n: new.get(n, self[n]) for n in self.kind.names}, agg=self.agg)

    def update(self, **fields: Any) -> E:
        """With fields replaced or added; they come last."""
        new = {n: v if isinstance(v, E) else lit(v) for n, v in fields.items()}
        return self._made({n: self[n] for n in self._product().names if n not in new} | new)

    def merge(self, other: E) -> E:
        """Fields of both products, which must have different names."""
        both = set(self._product().names) & set(other._product().names)
        require(not both, f"both sides have {sorted(both)}")
        return self._made({n: self[n] for n in self.kind.names} | {n: other[n] for n in other.kind.names})

    def to_named(self, *names: str) -> E:
        """The fields in order under other names."""
        require(len(names) == len(self._product().names), f"{len(self.kind.names)} names for {self.kind}")
        return self._made({new: self[old] for new, old in zip(names, self.kind.names, strict=True)})

    def unnest(self) -> E:
        """All fields of the fields."""
        return functools.reduce(E.merge, (self[n].opened() for n in self._product().names))

    def select_kind(self, model: Any) -> E:
        """The one field of a kind."""
        return self[field_of_kind(self._product(), kind_of(model))]

    def remove_kind(self, model: Any) -> E:
        """All fields but the one of a kind."""
        name = field_of_kind(self._product(), kind_of(model))
        return self._made({n: self[n] for n in self.kind.names if n != name})

    def head(self) -> E:
        return self[self._product().names[0]]

    def tail(self) -> E:
        return tuple_(*(self[n] for n in self._product().names[1:]))

    def prepend(self, value: Any) -> E:
        return tuple_(_lift(value), *(self[n] for n in self._product().names))

    # --- sums --------------------------------------------------------------------------------------------------------

    def is_case(self, name: str) -> E:
        require(isinstance(self.kind, Sum) and name in dict(self.kind.variants), f"no variant {name!r} in {self.kind}")
        return self._like(BOOL, self.col["discriminant"] == name)

    def as_case(self, name: str) -> E:
        """The payload of a variant, if the value is that variant."""
        test, payload = self.is_case(name), dict(self.kind.variants)[name]
        inner = self.col[name] if payload.fields else F.struct(F.lit(None).alias(EMPTY))
        if payload.fields and all(is_opt(k) for _, k in payload.fields):  # a missing payload of optional fields is one of nulls
            inner = F.coalesce(inner, F.struct(*(F.lit(None).cast(cast_type(k)).alias(n) for n, k in payload.fields)))
        return self._like(Opt(payload), F.when(test.col, inner))

    def match(self, **handlers: Callable[[E], E]) -> E:
        """One handler for each variant, all of them."""
        require(isinstance(self.kind, Sum), f"{self.kind} has no variants")
        missing = set(dict(self.kind.variants)) ^ set(handlers)
        require(not missing, f"match needs each variant of {self.kind} once; see {sorted(missing)}")
        out = [(self.is_case(n), handlers[n](self.as_case(n)._inner())) for n, _ in self.kind.variants]
        kinds = {str(v.kind) for _, v in out}
        require(len(kinds) == 1, f"handlers give {sorted(kinds)}")
        col = F.raise_error(F.lit("unknown variant")).cast(cast_type(out[0][1].kind))
        for test, value in reversed(out):
            col = F.when(test.col, value.col).otherwise(col)
        return self._like(out[0][1].kind, col, *(v for _, v in out))

    # --- user functions ----------------------------------------------------------------------------------------------

    def udf(self, f: Callable[[Any], Any], to: Any) -> E:
        """An opaque Python function of the value, in Arrow batches; works on aggregate results as well."""
        kind = kind_of(to)
        return self._like(kind, F.udf(f, cast_type(kind), useArrow=True)(self.col))


def can_cast(source: Kind, to: Kind) -> bool:
    if source == to:
        return True
    if source in INTEGRAL:
        if isinstance(to, Dec):
            return to.precision - to.scale >= (3, 5, 10, 19)[INTEGRAL.index(source)]
        return to in (*INTEGRAL[INTEGRAL.index(source) + 1 :], *FLOATING, STRING)
    if source in FLOATING:
        return to in FLOATING
    if isinstance(source, Dec):
        return to in FLOATING or (isinstance(to, Dec) and to.scale >= source.scale and to.precision - to.scale >= source.precision - source.scale)
    return source == STRING and to == BINARY


def can_try_cast(source: Kind, to: Kind) -> bool:
    if source in INTEGRAL:
        return to in INTEGRAL[: INTEGRAL.index(source)]
    if source in FLOATING:
        return isinstance(to, Dec)
    if isinstance(source, Dec):
        return isinstance(to, Dec) or to == LONG
    return source == STRING and to in INTEGRAL


def _condition(e: E) -> Column:
    require(e.kind == BOOL, f"{e.kind} is no condition")
    return e.col


def _boxed(e: E) -> E:
    """As the content of an optional value: an optional one gets a wrapper."""
    return E(e.kind, F.struct(e.col.alias("value")), agg=e.agg) if is_opt(e.kind) else e


def _lift(value: Any) -> E:
    return value if isinstance(value, E) else lit(value)


def lit(value: Any, kind: Any = None) -> E:
    """A literal; its kind follows from the Python value unless given."""
    kind = kind_of(kind) if kind is not None else _guess(value)
    return E(kind, _literal(kind, encode(kind, value)))


def _guess(value: Any) -> Kind:
    if isinstance(value, bool):
        return BOOL
    if isinstance(value, int):
        return INT if -(2**31) <= value < 2**31 else LONG
    if isinstance(value, decimal.Decimal):
        scale = max(0, -int(value.as_tuple().exponent))
        return Dec(max(len(value.as_tuple().digits), scale, 1), scale)
    if isinstance(value, (list, set)):
        require(bool(value), "an empty sequence needs a kind")
        return Seq(_guess(next(iter(value))))
    if isinstance(value, tuple):
        return tuple_of(*map(_guess, value))
    if isinstance(value, dict):
        require(bool(value), "an empty map needs a kind")
        return Map(_guess(next(iter(value))), _guess(next(iter(value.values()))))
    if isinstance(value, Some):
        return Opt(_guess(value.value))
    require(value is not None, "a null literal needs a kind")
    for base in type(value).__mro__:
        if getattr(base, "__sealed__", None) is base:
            return kind_of(base)
    return kind_of(type(value))


def _literal(kind: Kind, value: Any) -> Column:
    if value is None:
        return F.lit(None).cast(cast_type(kind))
    if isinstance(kind, Opt):
        return F.struct(_literal(kind.of, value["value"]).alias("value")) if is_opt(kind.of) else _literal(kind.of, value)
    if isinstance(kind, Seq):
        return F.array(*(_literal(kind.of, x) for x in value)).cast(cast_type(kind))
    if isinstance(kind, Map):
        return F.create_map(*(c for k, v in value.items() for c in (_literal(kind.key, k), _literal(kind.value, v)))).cast(cast_type(kind))
    if isinstance(kind, Product):
        return F.struct(*(_literal(k, x).alias(n) for (n, k), x in zip(kind.fields, value, strict=True))) if kind.fields else F.struct(F.lit(None).alias(EMPTY))
    if isinstance(kind, Sum):
        fields = [(n, p) for n, p in kind.variants if p.fields]
        return F.struct(F.lit(value[0]).alias("discriminant"), *(_literal(p, v).alias(n) for (n, p), v in zip(fields, value[1:], strict=True)))
    if kind == TIMESTAMP:
        return F.timestamp_micros(F.lit((value - EPOCH) // datetime.timedelta(microseconds=1)))
    if kind == DATE:
        return F.lit(value.isoformat()).cast("date")
    return F.lit(value).cast(cast_type(kind))


def none(kind: Any) -> E:
    """No value of an optional kind."""
    own = Opt(kind_of(kind))
    return E(own, F.lit(None).cast(cast_type(own)))


def some(value: Any) -> E:
    """A present value."""
    e = _lift(value)
    return E(Opt(e.kind), _boxed(e).col, agg=e.agg)


def raise_error(message: Any, kind: Any) -> E:
    """An error where the value is needed."""
    kind = kind_of(kind)
    return E(kind, F.raise_error(message.col if isinstance(message, E) else F.lit(message)).cast(cast_type(kind)))


def coalesce(first: E, *others: E) -> E:
    """The first present value; evaluated in turn."""
    for e in (first, *others):
        require(unwrap(e.kind) == unwrap(first.kind), f"coalesce of {first.kind} and {e.kind}")
    last = others[-1] if others else first
    return E(last.kind, F.coalesce(first.col, *(e.col for e in others)), agg=any(e.agg for e in (first, *others)))


def tuple_(*values: Any) -> E:
    parts = {f"_{i}": _lift(v) for i, v in enumerate(values, 1)}
    return E(Product(tuple((n, p.kind) for n, p in parts.items()), tuple), None, parts)


def named(**values: Any) -> E:
    parts = {n: _lift(v) for n, v in values.items()}
    return E(Product(tuple((n, p.kind) for n, p in parts.items())), None, parts)


def make(model: Any, **values: Any) -> E:
    """A product of a model from its fields."""
    kind = kind_of(model)
    require(isinstance(kind, Product) and sorted(kind.names) == sorted(values), f"{kind} needs exactly its fields")
    parts = {n: values[n] if isinstance(values[n], E) else lit(values[n], k) for n, k in kind.fields}
    for n, k in kind.fields:
        require(parts[n].kind == k, f"field {n!r} is {k}, not {parts[n].kind}")
    return E(kind, None, parts)


def as_base(model: Any, name: str, payload: E | None = None) -> E:
    """A variant as a value of its sum."""
    kind = kind_of(model)
    require(isinstance(kind, Sum) and name in dict(kind.variants), f"no variant {name!r} in {kind}")
    fields = [F.lit(name).alias("discriminant")]
    for n, p in kind.variants:
        if p.fields:
            if n == name:
                require(payload is not None and payload.kind == p, f"variant {n!r} needs {p}")
            fields.append((payload.col if n == name and payload is not None else F.lit(None)).cast(cast_type(p)).alias(n))
    return E(kind, F.struct(*fields))


def seq(*values: Any, of: Any = None) -> E:
    items = [v if isinstance(v, E) else lit(v, of) for v in values]
    kind = kind_of(of) if of is not None else items[0].kind if items else None
    require(kind is not None and all(i.kind == kind for i in items), "a sequence needs one kind; give `of` for an empty one")
    return E(Seq(kind), F.array(*(i.col for i in items)).cast(cast_type(Seq(kind))), agg=any(i.agg for i in items))


def range_(start: Any, end: Any) -> E:
    """From start up to but not including end; empty if end is not larger."""
    a, b = (x if isinstance(x, E) else lit(x) for x in (start, end))
    require(a.kind == b.kind and a.kind in (INT, LONG), "a range needs two ints or two longs")
    kind = Seq(a.kind)
    return E(kind, F.when(b.col > a.col, F.sequence(a.col, b.col - 1)).otherwise(F.array().cast(cast_type(kind))))


def make_map(*pairs: tuple[Any, Any]) -> E:
    """From pairs; a key that occurs twice is an error."""
    return seq(*(tuple_(k, v) for k, v in pairs)).to_map()


class Cases:
    """when(test, value).when(...).otherwise(value): the first test that holds decides; later ones aren't evaluated."""

    def __init__(self, branches: list[tuple[E, E]]):
        self.branches = branches

    def when(self, test: E, value: Any) -> Cases:
        first = self.branches[0][1] if self.branches else None
        value = value if isinstance(value, E) else lit(value, first.kind if first is not None else None)
        require(first is None or first.kind == value.kind, f"branches of {first.kind if first is not None else ''} and {value.kind}")
        _condition(test)
        return Cases([*self.branches, (test, value)])

    def otherwise(self, value: Any) -> E:
        kind = self.branches[0][1].kind
        value = value if isinstance(value, E) else lit(value, kind)
        require(value.kind == kind, f"branches of {kind} and {value.kind}")
        out = value.col
        for test, each in reversed(self.branches):
            out = F.when(test.col, each.col).otherwise(out)
        return E(kind, out, agg=any(t.agg or v.agg for t, v in self.branches) or value.agg)


def cases() -> Cases:
    return Cases([])


def ternary(test: E, yes: Any, no: Any) -> E:
    return Cases([]).when(test, yes).otherwise(no)


def when(test: E, value: Any) -> E:
    """The value where the test holds, else nothing."""
    value = _lift(value)
    return E(Opt(value.kind), F.when(_condition(test), _boxed(value).col), agg=test.agg or value.agg)


def smaller(a: E, b: E) -> E:
    return ternary(a < b, a, b)


def larger(a: E, b: E) -> E:
    return ternary(a < b, b, a)


def micros_to_timestamp(e: E) -> E:
    return E(TIMESTAMP, F.timestamp_micros(e.col), agg=e.agg)


def micros_to_duration(e: E) -> E:
    return E(DURATION, e.col, agg=e.agg)


def days_to_date(e: E) -> E:
    return E(DATE, F.date_from_unix_date(e.col), agg=e.agg)


def rand(seed: int | None = None) -> E:
    return E(DOUBLE, F.rand(seed) if seed is not None else F.rand())


def sql_column(col: Column, kind: Any) -> E:
    """A plain column as an expression of a stated kind: the way in for Spark functions that have no typed form."""
    return E(kind_of(kind), col)


def row_of(fields: list[tuple[str, Kind, Column]], cls: Any = None) -> E:
    """A product over flat columns."""
    return E(Product(tuple((n, k) for n, k, _ in fields), cls), None, {n: E(k, c) for n, k, c in fields})


__all__ = ["Cases", "E", "Enum", "as_base", "can_cast", "can_try_cast", "cases", "coalesce", "days_to_date", "kind_from_spark", "larger", "lit", "make", "make_map", "micros_to_duration", "micros_to_timestamp", "named", "none", "raise_error", "rand", "range_", "row_of", "seq", "smaller", "some", "sql_column", "ternary", "tuple_", "when"]
