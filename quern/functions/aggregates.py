"""Aggregate expressions. Scalar operations apply to them as to any expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from quern.functions.expr import E, lit, when
from quern.types import BOOL, LONG, Seq, cast_type, comparable, groupable, is_opt, require, sum_kind, unwrap


def count() -> E:
    """Rows, whatever they hold."""
    return E(LONG, F.count(F.lit(1)), agg=True)


def count_some(e: E) -> E:
    """Rows with a value."""
    require(is_opt(e.kind), f"{e.kind} is never null; use count")
    return E(LONG, F.count(F.when(~e.is_empty().col, 1)), agg=True)


def count_if(test: E) -> E:
    return count_some(when(test, lit(1)))


def count_distinct(e: E) -> E:
    """Distinct values; nulls don't count. Flat products are counted by their columns."""
    require(groupable(e.kind), f"no equality for {e.kind}")
    return E(LONG, F.count_distinct(e.col), agg=True)


def bool_and(e: E) -> E:
    require(e.kind == BOOL, f"{e.kind} is no boolean")
    return E(BOOL, F.bool_and(e.col), agg=True)


def bool_or(e: E) -> E:
    require(e.kind == BOOL, f"{e.kind} is no boolean")
    return E(BOOL, F.bool_or(e.col), agg=True)


def min_(e: E) -> E:
    require(comparable(unwrap(e.kind)), f"no order for {e.kind}")
    return E(e.kind, F.min(e.col), agg=True)


def max_(e: E) -> E:
    """NaN is the largest."""
    require(comparable(unwrap(e.kind)), f"no order for {e.kind}")
    return E(e.kind, F.max(e.col), agg=True)


def min_by(value: E, by: E) -> E:
    """The value where `by` is smallest; which of equals is open."""
    return E(value.kind, F.min_by(value.col, by.col), agg=True)


def max_by(value: E, by: E) -> E:
    return E(value.kind, F.max_by(value.col, by.col), agg=True)


def sum_(e: E) -> E:
    """Integers give long, floats double, decimals of 38 digits themselves; an overflow is an error; null only if all are."""
    kind = sum_kind(e.kind)
    return E(kind, F.sum(e.col.cast(cast_type(unwrap(kind)))).cast(cast_type(unwrap(kind))), agg=True)


def collect(e: E) -> E:
    """All values, nulls too, in no particular order."""
    if is_opt(e.kind):
        return E(Seq(e.kind), F.transform(F.collect_list(F.struct(e.col.alias("v"))), lambda x: x["v"]), agg=True)
    return E(Seq(e.kind), F.collect_list(e.col), agg=True)


def concat(e: E) -> E:
    """All sequences as one."""
    require(isinstance(e.kind, Seq), f"{e.kind} is no sequence")
    return E(e.kind, F.flatten(F.collect_list(e.col)), agg=True)


def reduce(e: E, f: Callable[[E, E], E]) -> E:
    """An associative function of expressions over all values. A grouped dataset's own `reduce` does the same in two steps."""
    many = F.transform(F.collect_list(F.struct(e.col.alias("v"))), lambda x: x["v"])
    folded = F.aggregate(F.slice(many, F.lit(2), F.size(many)), F.get(many, F.lit(0)), lambda a, x: f(E(e.kind, a), E(e.kind, x)).col.cast(cast_type(e.kind)))
    return E(e.kind, folded, agg=True)
