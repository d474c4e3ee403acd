import base64
import datetime
import decimal
import math
import random
from dataclasses import dataclass

import pytest

from quern.functions.expr import as_base, cases, coalesce, lit, make, make_map, named, none, raise_error, range_, seq, some, ternary, tuple_, when
from quern.functions.json import from_json, to_json
from quern.operators import Dataset
from quern.types import BINARY, BYTE, DATE, DOUBLE, FLOAT, INT, LONG, SHORT, STRING, TIMESTAMP, Dec, Int, Long, Map, Opt, Seq, Some, TypeProblem, kind_of, product, sealed


def one(spark, e):
    """The value of an expression without a row."""
    return Dataset.of_rows(spark, int, [0]).select(lambda _: e).collect()[0]


def over(spark, kind, values, f):
    return Dataset.of_rows(spark, kind, values).select(f).collect()


def test_literals_of_all_kinds(spark):
    values = [True, 3, 2**40, "x'\"\\`\n\t${a}", b"\x00\xff", 1.5, datetime.date(1, 1, 1), datetime.date(9999, 12, 31), decimal.Decimal("12.30"), [1, 2], (1, "a"), {"a": 1}]
    for v in values:
        assert one(spark, lit(v)) == v
    assert one(spark, lit(datetime.datetime(2020, 1, 2, tzinfo=datetime.UTC))) is not None
    assert one(spark, lit(Some(None), Opt(Opt(INT)))) == Some(None)
    assert one(spark, none(Opt(INT))) is None
    assert one(spark, lit([], Seq(INT))) == []


def test_comparisons_and_booleans(spark):
    pairs = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    got = over(spark, tuple[int, int], pairs, lambda r: tuple_(r._1 < r._2, r._1 <= r._2, r._1 > r._2, r._1 >= r._2, r._1 == r._2, r._1 != r._2, (r._1 < r._2) | ~(r._1 == r._2)))
    assert got == [(a < b, a <= b, a > b, a >= b, a == b, a != b, a < b or a != b) for a, b in pairs]
    for wrong in (lambda: lit(1) == lit("a"), lambda: lit(1) == some(lit(1)), lambda: lit({"a": 1}) == lit({"a": 1}), lambda: lit([1]) < lit([2]), lambda: bool(lit(True)), lambda: lit(1) & lit(True)):
        with pytest.raises(TypeProblem):
            wrong()


def test_laziness(spark):
    bad = raise_error("boom", bool)
    assert one(spark, lit(False) & bad) is False
    assert one(spark, lit(True) | bad) is True
    assert one(spark, ternary(lit(True), lit(1), raise_error("boom", INT))) == 1
    assert one(spark, coalesce(some(1), raise_error("boom", Opt(INT)))) == 1
    with pytest.raises(Exception, match="boom"):
        one(spark, none(INT).expect("boom"))


def test_null_safe_equality(spark):
    values = [(a, b) for a in (None, 1, 2) for b in (None, 1, 2)]
    assert over(spark, tuple[Int | None, Int | None], values, lambda r: r._1 == r._2) == [a == b for a, b in values]
    assert over(spark, tuple[Int | None, Int | None], values, lambda r: tuple_(r._1, r._2) == tuple_(r._2, r._1)) == [a == b for a, b in values]


def test_numbers(spark):
    rng = random.Random(1)
    values = [(rng.randint(-(2**31), 2**31 - 1), rng.choice([-7, -1, 3, 2**31 - 1])) for _ in range(50)]
    assert over(spark, tuple[Int, Int], values[1:], lambda r: r._1.cast(LONG) // r._2.cast(LONG)) == [int(math.copysign(abs(a) // abs(b), a * b)) if a * b else 0 for a, b in values[1:]]
    with pytest.raises(Exception, match="(?i)overflow"):
        one(spark, lit(2**31 - 1) + 1)
    with pytest.raises(Exception, match="(?i)zero"):
        one(spark, lit(1) // 0)
    assert one(spark, lit(float("nan")).is_nan()) is True
    with pytest.raises(TypeProblem):
        lit("a") + "b"


def test_casts(spark):
    assert one(spark, tuple_(lit(5).cast(LONG), lit(5).cast(STRING), lit(5).cast(Dec(12, 2)), lit("é").cast(BINARY))) == (5, "5", decimal.Decimal("5.00"), "é".encode())
    assert one(spark, seq(1, 2).cast(Seq(LONG))) == [1, 2]
    for source, to in ((LONG, INT), (DOUBLE, INT), (STRING, INT), (Dec(10, 2), Dec(10, 3)), (INT, Dec(10, 2))):
        with pytest.raises(TypeProblem):
            none(source).expect("x").cast(to)
    texts = ["12", " 12 ", "+3", "-4", "1.5", "1e3", "", "abc", "12\x05", "٣", "99999999999", "128"]
    assert over(spark, str, texts, lambda t: t.try_cast(INT)) == [12, 12, 3, -4, None, None, None, None, None, None, None, 128]
    assert over(spark, str, texts[-1:], lambda t: t.try_cast(BYTE)) == [None]
    assert over(spark, int, [2**40, 300, 5], lambda x: tuple_(x.try_cast(INT), x.try_cast(SHORT), x.try_cast(BYTE))) == [(None, None, None), (300, 300, None), (5, 5, 5)]
    decimals = [decimal.Decimal("2.50"), decimal.Decimal("-2.50"), decimal.Decimal("2.49")]
    assert over(spark, Dec(10, 2), decimals, lambda d: d.try_cast(LONG)) == [3, -3, 2]
    assert one(spark, lit(1.25).try_cast(Dec(10, 1))) == decimal.Decimal("1.3")
    assert one(spark, lit(1.5).cast(FLOAT)) == 1.5


def test_strings(spark):
    rng = random.Random(2)
    values = ["".join(rng.choice("ab ,.\\E$^é😀") for _ in range(rng.randint(0, 12))) for _ in range(60)]
    for d in (",", ".", "\\E", " ", "ab", "$^"):
        assert over(spark, str, values, lambda t, d=d: t.split(d)) == [v.split(d) for v in values]
    assert over(spark, str, ["abc", ""], lambda t: t.split("")) == [["a", "b", "c", ""], [""]]
    assert over(spark, str, values, lambda t: t.trim()) == [v.strip(" ") for v in values]
    assert over(spark, str, values, lambda t: tuple_(t.starts_with("a"), t.ends_with("b"), t.concat("!"))) == [(v.startswith("a"), v.endswith("b"), v + "!") for v in values]
    raws = [rng.randbytes(n) for n in (0, 1, 5, 100)]
    assert over(spark, bytes, raws, lambda b: tuple_(b.to_base64(), b.length(), b.to_base64().from_base64())) == [(base64.b64encode(r).decode(), len(r), r) for r in raws]
    assert one(spark, lit("*no base64*").from_base64()) is None


def test_options(spark):
    values = [None, 1, 2]
    k = Opt(INT)
    assert over(spark, k, values, lambda x: x.map(lambda v: v + 1)) == [None, 2, 3]
    assert over(spark, k, values, lambda x: x.flat_map(lambda v: when(v > 1, v))) == [None, None, 2]
    assert over(spark, k, values, lambda x: x.filter(lambda v: v > 1)) == [None, None, 2]
    assert over(spark, k, values, lambda x: tuple_(x.exists(lambda v: v > 1), x.forall(lambda v: v > 1), x.contains(1), x.is_empty(), x.get_or_else(9))) == [(False, True, False, True, 9), (False, False, True, False, 1), (True, True, False, False, 2)]
    assert over(spark, k, values, lambda x: some(x)) == [Some(None), Some(1), Some(2)]
    assert over(spark, Opt(Opt(Opt(INT))), [None, Some(None), Some(Some(None)), Some(Some(3))], lambda x: x.flat_map(lambda y: y)) == [None, None, Some(None), Some(3)]
    assert over(spark, k, values, lambda x: x.zip(some(7))) == [None, (1, 7), (2, 7)]


def test_sequences(spark):
    rng = random.Random(3)
    values = [[rng.randint(-3, 3) for _ in range(rng.randint(0, 5))] for _ in range(40)]
    k = Seq(INT)
    assert over(spark, k, values, lambda s: s.map(lambda x: x + 1)) == [[x + 1 for x in v] for v in values]
    assert over(spark, k, values, lambda s: s.filter(lambda x: x > 0)) == [[x for x in v if x > 0] for v in values]
    assert over(spark, k, values, lambda s: s.flat_map(lambda x: when(x > 0, x))) == [[x for x in v if x > 0] for v in values]
    assert over(spark, k, values, lambda s: s.flat_map(lambda x: seq(x, x))) == [[y for x in v for y in (x, x)] for v in values]
    assert over(spark, k, values, lambda s: tuple_(s.size(), s.exists(lambda x: x > 2), s.forall(lambda x: x > -3), s.contains(0))) == [(len(v), any(x > 2 for x in v), all(x > -3 for x in v), 0 in v) for v in values]
    assert over(spark, k, values, lambda s: s.zip(seq("a", "b"))) == [list(zip(v, ["a", "b"], strict=False)) for v in values]
    assert over(spark, k, values, lambda s: s.distinct()) == [list(dict.fromkeys(v)) for v in values]
    assert over(spark, k, values, lambda s: s.map(lambda x: x.cast(STRING)).mk_string("-")) == ["-".join(map(str, v)) for v in values]
    assert one(spark, seq(some(1), none(INT)).contains(none(INT))) is True
    assert [one(spark, range_(a, b)) for a, b in ((0, 3), (3, 1), (2, 2), (-2, 1))] == [[0, 1, 2], [], [], [-2, -1, 0]]
    assert one(spark, seq(4, 5).get(1)) == 5
    for index in (2, -1):
        with pytest.raises(Exception, match="(?i)index|out of bounds"):
            one(spark, seq(4, 5).get(index))


def test_maps_and_products(spark):
    m = make_map(("a", 1), ("b", 2))
    assert one(spark, tuple_(m, m.get("a"), m.get("z"), m.entries())) == ({"a": 1, "b": 2}, 1, None, [("a", 1), ("b", 2)])
    optional = make_map(("a", none(INT)))
    assert one(spark, tuple_(optional.get("a"), optional.get("b"))) == (Some(None), None)
    with pytest.raises(Exception, match="(?i)duplicate"):
        one(spark, make_map(("a", 1), ("a", 2)))
    p = named(a=1, b="x")
    assert one(spark, p.update(a=2, c=3)) == {"b": "x", "a": 2, "c": 3}
    assert one(spark, p.copy(b="y")) == {"a": 1, "b": "y"}
    assert one(spark, p.merge(named(c=1.5))) == {"a": 1, "b": "x", "c": 1.5}
    assert one(spark, tuple_(p.select_kind(STRING), tuple_(1, 2).head(), tuple_(1, 2).tail(), tuple_(1).prepend("z"))) == ("x", 1, (2,), ("z", 1))
    assert one(spark, named(p=p, q=named(c=1)).unnest()) == {"a": 1, "b": "x", "c": 1}
    for wrong in (lambda: p.copy(b=1), lambda: p.merge(p), lambda: p.project(product(z=INT)), lambda: p.nothing, lambda: named(a=1, b=2).select_kind(INT)):
        with pytest.raises(TypeProblem):
            wrong()


def test_dates(spark):
    days = [datetime.date(1, 1, 1), datetime.date(1969, 12, 31), datetime.date(9999, 12, 31)]
    assert over(spark, DATE, days, lambda d: d.to_days()) == [(d - datetime.date(1970, 1, 1)).days for d in days]
    instants = [datetime.datetime(1969, 12, 31, 23, 59, 59, 999999, tzinfo=datetime.UTC), datetime.datetime(2024, 2, 29, 1, 2, 3, 4, tzinfo=datetime.UTC)]
    assert over(spark, TIMESTAMP, instants, lambda t: t.to_micros()) == [(i - datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)) // datetime.timedelta(microseconds=1) for i in instants]


@sealed
class Shape:
    pass


@dataclass
class Circle(Shape):
    radius: Int


@dataclass
class Box(Shape):
    width: Int | None


class Point(Shape):
    def __eq__(self, other):
        return isinstance(other, Point)


def test_sums(spark):
    values = [Circle(2), Box(None), Box(3), Point()]
    assert over(spark, Shape, values, lambda s: s) == values
    got = over(spark, Shape, values, lambda s: s.match(circle=lambda c: c.radius, box=lambda b: b.width.get_or_else(-1), point=lambda _: lit(0)))
    assert got == [2, -1, 3, 0]
    assert one(spark, as_base(Shape, "circle", make(Circle, radius=4))) == Circle(4)
    assert over(spark, Shape, values, lambda s: s.as_case("circle").map(lambda c: c.radius)) == [2, None, None, None]
    with pytest.raises(TypeProblem):
        lit(Circle(1)).match(circle=lambda c: c.radius)


@dataclass
class Doc:
    id: Long
    tags: list[str]
    note: str | None
    counts: dict[str, Int]
    price: __import__("quern.types", fromlist=["Decimal"]).Decimal(10, 2)
    day: datetime.date
    inner: Circle | None


def test_json_round_trip(spark):
    docs = [Doc(2**60, ["a", ""], None, {"x": 1, "y": -2}, decimal.Decimal("1.50"), datetime.date(2020, 1, 2), None), Doc(-1, [], "é", {}, decimal.Decimal("-9999999.99"), datetime.date(1, 1, 1), Circle(3))]
    assert over(spark, Doc, docs, lambda d: from_json(to_json(d), Doc)) == docs
    assert over(spark, Shape, [Circle(2), Box(None), Point()], lambda s: from_json(to_json(s), Shape)) == [Circle(2), Box(None), Point()]
    assert over(spark, Map(STRING, Opt(INT)), [{"a": None}], lambda m: from_json(to_json(m), Map(STRING, Opt(INT)))) == [{"a": None}]


def test_json_refuses_what_is_malformed(spark):
    texts = ["{", "}", "{}", "", "null", '{"id": 0}', '{"id": "x", "n": 1}', '{"id": 99999999999999999999, "n": 1}', '{"id": null, "n": 1}', '{"id": 1.5, "n": 1}', '{"id": 1, "n": 2}', '{"id": "1", "n": 2}', '{"id": 1, "n": 2, "more": []}']
    kind = product(id=LONG, n=INT)
    assert over(spark, str, texts, lambda t: from_json(t, kind)) == [None] * 10 + [{"id": 1, "n": 2}] * 3
    lists = ["[null]", "[1]", "[,]", '["1"]', "[]", "[2147483648]", "[{}]"]
    assert over(spark, str, lists, lambda t: from_json(t, Seq(INT))) == [None, [1], None, [1], [], None, None]
    with pytest.raises(TypeProblem):
        to_json(lit(1))


def test_user_functions(spark):
    assert over(spark, INT, [1, 2], lambda x: x.udf(lambda v: f"<{v}>", str)) == ["<1>", "<2>"]
    assert kind_of(dict[str, int]) == Map(STRING, LONG)
    assert over(spark, INT, [1, 2, 3], lambda x: cases().when(x < 2, "a").when(x < 3, "b").otherwise("c")) == ["a", "b", "c"]
