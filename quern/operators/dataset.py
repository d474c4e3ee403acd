"""Datasets: typed, lazy multisets of rows over a Spark DataFrame.

A row's fields live in flat columns with names of their own, so joins and aggregations that follow one another can use
the same partitioning, and a self-join has nothing to disambiguate. They are packed into structs only by `to_df`.
"""

from __future__ import annotations

import itertools
import warnings
import weakref
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quern.functions.expr import E, coalesce, kind_from_spark, named, tuple_
from quern.session import ship
from quern.types import BOOL, LONG, Kind, Map, Opt, Product, Seq, decode, encode, groupable, is_opt, kind_of, nullable, orderable, require, schema

_numbers = itertools.count()


def _fresh() -> str:
    return f"c{next(_numbers)}"


class Explode:
    """One row for each element; only at the top of a select."""

    def __init__(self, e: E):
        require(isinstance(e.kind, (Seq, Map, Opt)), f"nothing to explode in {e.kind}")
        self.e = e


def explode(e: E) -> Explode:
    return Explode(e)


def placed(df: DataFrame, row: E) -> Dataset:
    """A dataset whose flat columns are exactly the leaves of `row`, under new names."""
    leaves = list(row.leaves())
    names = {path: _fresh() for path, _, _ in leaves}
    out = df.select(*(c.alias(names[path]) for path, _, c in leaves)) if leaves else df.select(F.lit(None).alias(_fresh()))
    return Dataset(out, row.rebuilt(lambda path: F.col(names[path])))


class Dataset:
    """`row` is the row as an expression over the columns of `frame`."""

    def __init__(self, frame: DataFrame, row: E):
        self.frame, self.row = frame, row

    # --- in and out --------------------------------------------------------------------------------------------------

    @classmethod
    def of_df(cls, df: DataFrame, model: Any = None) -> Dataset:
        """A DataFrame as a dataset of a model: its fields by name, timestamps without zone read as UTC instants."""
        if model is None:
            fields = [(f.name, kind_from_spark(f.dataType, f.nullable)) for f in df.schema]
            kind: Kind = Product(tuple(fields))
        else:
            kind = kind_of(model)
        wanted = kind.fields if isinstance(kind, Product) else (("value", kind),)
        missing = [n for n, _ in wanted if n not in df.columns]
        require(not missing, f"no columns {missing}")

        def column(n: str, k: Kind) -> Column:
            col = df[f"`{n}`"]
            return col.cast("timestamp") if isinstance(df.schema[n].dataType, T.TimestampNTZType) else col

        parts = {n: E(k, column(n, k)) for n, k in wanted}
        return placed(df, E(kind, None, parts) if isinstance(kind, Product) else parts["value"])

    @classmethod
    def of_rows(cls, spark: SparkSession, model: Any, rows: Iterable[Any]) -> Dataset:
        kind = kind_of(model)
        values = [encode(kind, r) for r in rows]
        return cls.of_df(spark.createDataFrame(values if isinstance(kind, Product) else [(v,) for v in values], schema(kind)), kind)

    @classmethod
    def empty(cls, spark: SparkSession, model: Any) -> Dataset:
        return cls.of_rows(spark, model, [])

    @classmethod
    def single(cls, spark: SparkSession, model: Any, value: Any) -> Single:
        return Single(*_both(cls.of_rows(spark, model, [value])))

    @property
    def kind(self) -> Kind:
        return self.row.kind

    def to_df(self) -> DataFrame:
        """Columns named as the row's fields, or one column `value`."""
        row = self.row.opened()
        if isinstance(row.kind, Product) and row.parts:
            return self.frame.select(*(p.col.alias(n) for n, p in row.parts.items()))
        return self.frame.select(row.col.alias("value"))

    def collect(self) -> list[Any]:
        """All rows on the driver, as values of the model."""
        kind = self.kind
        whole = isinstance(kind, Product) and bool(kind.fields)
        return [decode(kind, r if whole else r[0]) for r in self.to_df().collect()]

    def explain(self, mode: str = "extended") -> str:
        return self.to_df()._jdf.queryExecution().explainString(self.frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))

    def show(self, n: int = 20) -> None:
        self.to_df().show(n, truncate=False)

    def cache(self) -> Dataset:
        """Keep the rows in memory until this object is gone."""
        frame = self.frame.persist()
        out = Dataset(frame, self.row)
        weakref.finalize(out, frame.unpersist)
        return out

    # --- rows --------------------------------------------------------------------------------------------------------

    def _apply(self, f: Callable[[E], Any] | E) -> Any:
        return f(self.row.opened()) if callable(f) else f

    def where(self, test: Callable[[E], E]) -> Dataset:
        e = self._apply(test)
        require(e.kind == BOOL, f"{e.kind} is no condition")
        return Dataset(self.frame.where(e.col), self.row)

    def select(self, *fs: Callable[[E], E | Explode]) -> Dataset:
        """One expression gives its own rows, several give tuples. Several explodes give all combinations."""
        frame, out = self.frame, []
        for f in fs:
            e = self._apply(f)
            if isinstance(e, Explode):
                frame, e = _exploded(frame, e.e)
            out.append(e)
        return placed(frame, out[0] if len(out) == 1 else tuple_(*out))

    def explode(self, f: Callable[[E], E]) -> Dataset:
        return self.select(lambda r: Explode(f(r)))

    def project(self, model: Any) -> Dataset:
        return self.select(lambda r: r.project(model))

    def as_(self, model: Any) -> Dataset:
        return self.select(lambda r: r.as_(model))

    def key_by(self, f: Callable[[E], E]) -> Dataset:
        return self.select(f, lambda r: r)

    def keys(self) -> Dataset:
        return self.select(lambda r: r.head())

    def values(self) -> Dataset:
        return self.select(lambda r: r[r.kind.names[1]])

    def pairs(self) -> Dataset:
        return self.select(lambda r: r.head(), lambda r: r[r.kind.names[1]])

    def select_values(self, f: Callable[[E], E]) -> Dataset:
        return self.select(lambda r: r.head(), lambda r: f(r[r.kind.names[1]].opened()))

    def map_values(self, f: Callable[[Any], Any], model: Any) -> Dataset:
        """An opaque function of the second field."""
        return self.map(lambda r: (r[0], f(r[1])), tuple_kind(self.kind.fields[0][1], kind_of(model)))

    def flat_map_values(self, f: Callable[[E], E]) -> Dataset:
        return self.select(lambda r: r.head(), lambda r: Explode(f(r[r.kind.names[1]].opened())))

    # --- opaque functions ----------------------------------------------------------------------------------------------

    def map_partitions(self, f: Callable[[Iterator[Any]], Iterator[Any]], model: Any) -> Dataset:
        """A function of an iterator of the rows of a partition, in Arrow batches."""
        kind, to = self.kind, kind_of(model)
        target = schema(to)
        arrow = to_arrow_schema(nullable(target))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (decode(kind, _positional(kind, r if isinstance(kind, Product) else r["value"])) for b in batches for r in b.to_pylist())
            held: list[dict] = []
            for value in f(rows):
                done = _plain(to, encode(to, value))
                held.append(done if isinstance(to, Product) else {"value": done})
                if len(held) >= 4096:
                    yield pa.RecordBatch.from_pylist(held, arrow)
                    held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, arrow)

        ship(self.frame.sparkSession)
        return Dataset.of_df(self.to_df().mapInArrow(run, nullable(target)), to)

    def map(self, f: Callable[[Any], Any], model: Any) -> Dataset:
        return self.map_partitions(lambda rows: map(f, rows), model)

    def flat_map(self, f: Callable[[Any], Iterable[Any]], model: Any) -> Dataset:
        return self.map_partitions(lambda rows: (y for x in rows for y in f(x)), model)

    def filter(self, f: Callable[[Any], bool]) -> Dataset:
        return self.map_partitions(lambda rows: (x for x in rows if f(x)), self.kind)

    # --- joins ---------------------------------------------------------------------------------------------------------

    def _marked(self) -> tuple[DataFrame, E, str]:
        """Under new names, with a column that is true wherever there is a row."""
        other, mark = placed(self.frame, self.row.opened()), _fresh()
        return other.frame.withColumn(mark, F.lit(True)), other.row, mark

    def _join(self, other: Dataset, on: Callable[[E, E], E], how: str) -> tuple[DataFrame, E, E]:
        left, left_row, left_mark = self._marked()
        right, right_row, right_mark = other._marked()
        test = on(left_row.opened(), right_row.opened())
        require(test.kind == BOOL, f"{test.kind} is no condition")
        if how in ("inner", "left"):
            left = left.drop(left_mark)
        if how in ("inner", "left_anti"):
            right = right.drop(right_mark)
        return left.join(right, test.col, how), _maybe(left_row, left_mark) if how == "full" else left_row, right_row if how in ("inner", "left_anti") else _maybe(right_row, right_mark)

    def join(self, other: Dataset, on: Callable[[E, E], E]) -> Dataset:
        """Pairs of rows for which any condition holds."""
        frame, left, right = self._join(other, on, "inner")
        return Dataset(frame, tuple_(left, right))

    def left_join(self, other: Dataset, on: Callable[[E, E], E]) -> Dataset:
        frame, left, right = self._join(other, on, "left")
        return Dataset(frame, tuple_(left, right))

    def right_join(self, other: Dataset, on: Callable[[E, E], E]) -> Dataset:
        frame, right, left = other._join(self, lambda b, a: on(a, b), "left")
        return Dataset(frame, tuple_(left, right))

    def full_join(self, other: Dataset, on: Callable[[E, E], E]) -> Dataset:
        frame, left, right = self._join(other, on, "full")
        return Dataset(frame, tuple_(left, right))

    def anti_join(self, other: Dataset, on: Callable[[E, E], E]) -> Dataset:
        """Rows of this side without a match."""
        frame, left, _ = self._join(other, on, "left_anti")
        return Dataset(frame, left)

    def _disjoint(self, other: Dataset) -> None:
        both = set(self.kind.names) & set(other.kind.names)
        require(not both, f"both sides have {sorted(both)}")

    def join_flat(self, other: Dataset, on: Callable[[E, E], E]) -> Dataset:
        self._disjoint(other)
        return self.join(other, on).select(lambda r: r._1.opened().merge(r._2.opened()))

    def left_join_flat(self, other: Dataset, on: Callable[[E, E], E]) -> Dataset:
        """Fields of the right side become optional."""
        self._disjoint(other)
        return self.left_join(other, on).select(lambda r: r._1.opened().merge(r._2.spread_option()))

    def right_join_flat(self, other: Dataset, on: Callable[[E, E], E]) -> Dataset:
        self._disjoint(other)
        return self.right_join(other, on).select(lambda r: r._1.spread_option().merge(r._2.opened()))

    def full_join_flat(self, other: Dataset, on: Callable[[E, E], E]) -> Dataset:
        self._disjoint(other)
        return self.full_join(other, on).select(lambda r: r._1.spread_option().merge(r._2.spread_option()))

    def _on_key(self, other: Dataset, how: str) -> Dataset:
        joined = getattr(self, how)(other, lambda a, b: a.head() == b.head())
        second = lambda e: e[e.kind.names[1]]
        if how == "join":
            return joined.select(lambda r: r._1.head(), lambda r: tuple_(second(r._1), second(r._2)))
        if how == "left_join":
            return joined.select(lambda r: r._1.head(), lambda r: tuple_(second(r._1), r._2.map(second)))
        if how == "right_join":
            return joined.select(lambda r: r._2.head(), lambda r: tuple_(r._1.map(second), second(r._2)))
        key = lambda r: coalesce(r._1.map(lambda e: e.head()), r._2.map(lambda e: e.head())).expect("a key on neither side")
        return joined.select(key, lambda r: tuple_(r._1.map(second), r._2.map(second)))

    def join_pairs(self, other: Dataset) -> Dataset:
        """(K, V) with (K, W) as (K, (V, W))."""
        return self._on_key(other, "join")

    def left_join_pairs(self, other: Dataset) -> Dataset:
        return self._on_key(other, "left_join")

    def right_join_pairs(self, other: Dataset) -> Dataset:
        return self._on_key(other, "right_join")

    def full_join_pairs(self, other: Dataset) -> Dataset:
        return self._on_key(other, "full_join")

    def anti_join_pairs(self, other: Dataset) -> Dataset:
        return self.anti_join(other, lambda a, b: a.head() == b.head())

    # --- aggregation ---------------------------------------------------------------------------------------------------

    def aggregate(self, *fs: Callable[[E], E]) -> Single:
        """One row: nothing if there were no rows, even for a count."""
        out = [self._apply(f) for f in fs]
        require(all(e.agg for e in out), "aggregate takes aggregate expressions")
        row = (out[0] if len(out) == 1 else tuple_(*out)).opened()
        leaves, rows = list(row.leaves()), _fresh()
        names = {path: _fresh() for path, _, _ in leaves}
        frame = self.frame.agg(F.count(F.lit(1)).alias(rows), *(c.alias(names[p]) for p, _, c in leaves))
        return Single(frame, _optional(row.rebuilt(lambda p: F.col(names[p])), F.col(rows) > 0))

    def count(self) -> Single:
        """How many rows; 0 if there are none."""
        name = _fresh()
        return Single(self.frame.agg(F.count(F.lit(1)).alias(name)), E(LONG, F.col(name)))

    def collect_rows(self) -> Single:
        """All rows as one sequence."""
        name = _fresh()
        return Single(self.frame.agg(F.collect_list(F.struct(self.row.col.alias("v"))).alias(name)), E(Seq(self.kind), F.transform(F.col(name), lambda x: x["v"])))

    def group_by(self, **keys: Callable[[E], E]) -> Any:
        """By named keys; results have them as fields."""
        from quern.operators.grouped import GroupedDataset

        return GroupedDataset(self, named(**{n: self._apply(f) for n, f in keys.items()}), self.row)

    def group_by_key(self, f: Callable[[E], E]) -> Any:
        """By one key, the field `key` of results."""
        from quern.operators.grouped import GroupedDataset

        return GroupedDataset(self, named(key=self._apply(f)), self.row)

    def grouped(self) -> Any:
        """(K, V) rows by K, with V as the value."""
        from quern.operators.grouped import GroupedDataset

        row = self.row.opened()
        return GroupedDataset(self, named(key=row.head()), row[row.kind.names[1]])

    def reduce(self, f: Callable[[E, E], E]) -> Dataset:
        """(K, V) rows to one row for each K, by an associative function."""
        return self.grouped().reduce(f)

    # --- order and sets ------------------------------------------------------------------------------------------------

    def order_by(self, *fs: Callable[[E], E]) -> Dataset:
        """Ascending, nulls first, products field by field."""
        keys = [self._apply(f) for f in fs]
        for k in keys:
            require(orderable(k.kind), f"no order for {k.kind}")
        cols = [c.asc_nulls_first() for k in keys for _, _, c in k.opened().leaves()]
        return Dataset(self.frame.sort(*cols), self.row)

    def limit(self, n: int) -> Dataset:
        """The first n rows; a large n goes through one task, so a warning says so."""
        require(n >= 0, "limit needs n >= 0")
        if n > 10_000:
            warnings.warn(f"limit({n}) gathers that many rows in one task", stacklevel=2)
        return Dataset(self.frame.limit(n), self.row)

    def distinct(self) -> Dataset:
        require(groupable(self.kind), f"no equality for {self.kind}")
        own = placed(self.frame, self.row)
        return Dataset(own.frame.distinct(), own.row)

    def _matched(self, other: Dataset) -> tuple[Dataset, Dataset]:
        require(self.kind == other.kind, f"rows of {self.kind} and {other.kind}")
        one, two = self.to_df(), other.to_df()
        return Dataset(one, self.row), Dataset(two.select(*one.columns), other.row)

    def union(self, other: Dataset) -> Dataset:
        """All rows of both, equal ones too; fields by name."""
        a, b = self._matched(other)
        return Dataset.of_df(a.frame.unionByName(b.frame), self.kind)

    def except_(self, other: Dataset) -> Dataset:
        """Distinct rows of this side that the other lacks."""
        require(groupable(self.kind), f"no equality for {self.kind}")
        a, b = self._matched(other)
        return Dataset.of_df(a.frame.subtract(b.frame), self.kind)

    def exists(self) -> E:
        """Whether there is any row, as an expression for another dataset."""
        return E(BOOL, self.frame.exists())


class Single(Dataset):
    """A dataset of exactly one row."""

    @property
    def value(self) -> E:
        """The row as an expression for another dataset: a lazy scalar subquery."""
        return E(self.kind, self.frame.select(self.row.col.alias(_fresh())).scalar())

    def collect_value(self) -> Any:
        rows = self.collect()
        require(len(rows) == 1, f"{len(rows)} rows instead of one")
        return rows[0]


def tuple_kind(*kinds: Kind) -> Product:
    return Product(tuple((f"_{i}", k) for i, k in enumerate(kinds, 1)), tuple)


def _both(ds: Dataset) -> tuple[DataFrame, E]:
    return ds.frame, ds.row


def _optional(row: E, present: Column) -> E:
    if row.parts is not None and row.present is None and not is_opt(row.kind):
        return E(Opt(row.kind), None, row.parts, present)
    inner = F.struct(row.col.alias("value")) if is_opt(row.kind) else row.col
    return E(Opt(row.kind), F.when(present, inner))


def _maybe(row: E, mark: str) -> E:
    return _optional(row, F.col(mark).isNotNull())


def _exploded(frame: DataFrame, e: E) -> tuple[DataFrame, E]:
    if isinstance(e.kind, Opt):
        return frame.where(~e.is_empty().col), e._inner()
    if isinstance(e.kind, Map):
        e = e.entries()
    name = _fresh()
    return frame.select("*", F.explode(e.col).alias(name)), E(e.kind.of, F.col(name))


def _positional(kind: Kind, value: Any) -> Any:
    """What Arrow gives (dicts) in the form that decode takes (by position)."""
    if value is None:
        return None
    if isinstance(kind, Opt):
        return {"value": _positional(kind.of, value["value"])} if is_opt(kind.of) else _positional(kind.of, value)
    if isinstance(kind, Seq):
        return [_positional(kind.of, x) for x in value]
    if isinstance(kind, Map):
        return {_positional(kind.key, k): _positional(kind.value, v) for k, v in (value.items() if isinstance(value, dict) else value)}
    if isinstance(kind, Product):
        return [_positional(k, value[n]) for n, k in kind.fields]
    if hasattr(kind, "variants"):
        return {"discriminant": value["discriminant"]} | {n: _positional(p, value[n]) for n, p in kind.variants if p.fields}
    return value


def _plain(kind: Kind, value: Any) -> Any:
    """What encode gives as Arrow takes it."""
    if value is None:
        return None
    if isinstance(kind, Opt):
        return {"value": _plain(kind.of, value["value"])} if is_opt(kind.of) else _plain(kind.of, value)
    if isinstance(kind, Seq):
        return [_plain(kind.of, x) for x in value]
    if isinstance(kind, Map):
        return [(_plain(kind.key, k), _plain(kind.value, v)) for k, v in value.items()]
    if isinstance(kind, Product):
        return {n: _plain(k, x) for (n, k), x in zip(kind.fields, value, strict=False)}
    if hasattr(kind, "variants"):
        return {"discriminant": value[0]} | {n: _plain(p, v) for (n, p), v in zip([v for v in kind.variants if v[1].fields], value[1:], strict=True)}
    return value


__all__ = ["Dataset", "Explode", "Single", "explode", "placed", "tuple_kind"]
