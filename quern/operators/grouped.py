"""Grouped datasets: a key and a value over the rows of a dataset, until an aggregation makes rows again."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import functions as F

from quern.functions import aggregates
from quern.functions.expr import E
from quern.operators.dataset import Dataset, _fresh
from quern.types import Product, groupable, kind_of, require

#: Parts that a group is dealt into for the first of two reductions.
_PARTS = 32


class GroupedDataset:
    def __init__(self, source: Dataset, key: E, value: E):
        require(groupable(key.kind), f"no grouping by {key.kind}")
        self.source, self.key, self.value = source, key, value

    def select_values(self, f: Callable[[E], E]) -> GroupedDataset:
        return GroupedDataset(self.source, self.key, f(self.value.opened()))

    def map_values(self, f: Callable[[Any], Any], model: Any) -> GroupedDataset:
        """An opaque function of each value before the aggregation."""
        return GroupedDataset(self.source, self.key, self.value.udf(f, kind_of(model)))

    def _aggregate(self, out: dict[str, E], salt: bool = False) -> Dataset:
        both = set(self.key.kind.names) & set(out)
        require(not both, f"keys and aggregates share {sorted(both)}")
        require(all(e.agg for e in out.values()), "aggregate takes aggregate expressions")
        keys = [(path, c, _fresh()) for path, _, c in self.key.opened().leaves()]  # aliased: a bare number would be a column's place
        made = [(("", n, *path), c, _fresh()) for n, e in out.items() for path, _, c in e.leaves()]
        by = [c.alias(name) for _, c, name in keys] or [F.lit(1).alias(_fresh())]  # without keys still no row from no rows
        if salt:
            by = [*by, F.pmod(F.spark_partition_id(), F.lit(_PARTS)).alias(_fresh())]
        frame = self.source.frame.groupBy(*by).agg(*(c.alias(name) for _, c, name in made))
        at = {path: name for path, _, name in [*keys, *made]}
        key = self.key.rebuilt(lambda p: F.col(at[p]))
        parts = dict(key.parts) | {n: e.rebuilt(lambda p, n=n: F.col(at[("", n, *p)])) for n, e in out.items()}
        return Dataset(frame, E(Product(tuple((n, p.kind) for n, p in parts.items())), None, parts))

    def aggregate(self, **fs: Callable[[E], E]) -> Dataset:
        """The key's fields and then one field for each named aggregate of the value."""
        return self._aggregate({n: f(self.value.opened()) for n, f in fs.items()})

    def aggregate_value(self, f: Callable[[E], E]) -> Dataset:
        return self.aggregate(value=f)

    def count(self) -> Dataset:
        return self.aggregate(count=lambda _: aggregates.count())

    def reduce(self, f: Callable[[E, E], E]) -> Dataset:
        """An associative function of two values, as expressions. Groups are dealt into parts that are reduced first, so no task gathers a whole group."""
        half = self._aggregate({"value": aggregates.reduce(self.value, f)}, salt=True)
        row = half.row
        key = E(self.key.kind, None, {n: row.parts[n] for n in self.key.kind.names})
        return GroupedDataset(half, key, row.parts["value"])._aggregate({"value": aggregates.reduce(row.parts["value"], f)})
