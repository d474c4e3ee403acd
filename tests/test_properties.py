"""Random rows through Spark and back, and operators against plain Python on them."""

import datetime
import enum
import math
from dataclasses import dataclass, replace

from quern.functions import aggregates as A
from quern.functions.json import from_json, to_json
from quern.operators import Dataset
from quern.testing import for_all
from quern.types import Byte, Decimal, Double, Int, Long, Short, sealed


class Colour(enum.Enum):
    Red = 1
    DarkBlue = 2


@sealed
class Shape:
    pass


@dataclass
class Circle(Shape):
    radius: Int
    name: str | None


@dataclass
class Nothing(Shape):
    why: str | None


@dataclass
class Row:
    a: Byte
    b: Short
    c: Int
    d: Long | None
    e: str
    f: bytes
    g: Decimal(20, 4)
    h: datetime.date
    i: datetime.timedelta
    j: list[Int | None]
    k: dict[str, Int]
    l: Colour
    m: Shape
    n: tuple[Int, str] | None
    o: bool


def same(a, b):
    return sorted(map(said, a)) == sorted(map(said, b))


def said(x):
    """A map's order means nothing."""
    return repr(replace(x, k=dict(sorted(x.k.items()))) if isinstance(x, Row) else x)


def test_rows_survive(spark):
    def check(rows):
        assert same(Dataset.of_rows(spark, Row, rows).collect(), rows)

    for_all(Row, check, runs=4, most=12)


def test_rows_survive_json(spark):
    def check(rows):
        assert same(Dataset.of_rows(spark, Row, rows).select(lambda r: from_json(to_json(r), Row)).collect(), rows)

    for_all(Row, check, runs=3, most=12, seed=1)


def test_floats_survive(spark):
    def check(rows):
        got = Dataset.of_rows(spark, Double, rows).collect()
        assert len(got) == len(rows) and sorted(map(repr, got)) == sorted(map(repr, rows))
        most = Dataset.of_rows(spark, Double, rows).aggregate(lambda x: A.max_(x)).collect_value()
        assert most is None if not rows else (math.isnan(most) if any(math.isnan(x) for x in rows) else most == max(rows))

    for_all(Double, check, runs=4, most=8, seed=2)


def test_grouping_and_sets(spark):
    def check(rows):
        rows = [(a % 3, b) for a, b in rows]
        ds = Dataset.of_rows(spark, tuple[Int, Int | None], rows)
        counted = {r["key"]: r["count"] for r in ds.group_by_key(lambda r: r).count().collect()}
        assert counted == {r: rows.count(r) for r in rows}
        assert same(ds.distinct().collect(), set(rows)) and same(ds.union(ds).collect(), rows * 2) and ds.except_(ds).collect() == []

    for_all(tuple[Int, Int | None], check, runs=3, most=10, seed=3)
