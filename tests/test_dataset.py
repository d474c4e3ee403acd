import gc
import random
from dataclasses import dataclass

import pytest

from quern.functions import aggregates as A
from quern.functions.expr import E, lit, named, seq, tuple_, when
from quern.operators import Dataset, explode
from quern.types import BOOL, DOUBLE, INT, LONG, Dec, Int, Map, Opt, Some, STRING, TypeProblem, product


@dataclass(frozen=True)
class Pair:
    k: Int
    v: Int | None


@pytest.fixture(scope="module")
def sides():
    rng = random.Random(5)
    make = lambda n: [Pair(rng.randint(-2, 2), rng.choice([None, rng.randint(-3, 3)])) for _ in range(n)]
    return make(12), make(9)


def multiset(rows):
    return sorted(rows, key=repr)


def test_joins_against_plain_python(spark, sides):
    a, b = sides
    l, r = Dataset.of_rows(spark, Pair, a), Dataset.of_rows(spark, Pair, b)
    conditions = [
        (lambda x, y: x.k == y.k, lambda x, y: x.k == y.k),
        (lambda x, y: (x.k == y.k) & (x.v == y.v), lambda x, y: x.k == y.k and x.v == y.v),
        (lambda x, y: x.k < y.k, lambda x, y: x.k < y.k),
        (lambda x, y: (x.k == y.k) | (x.k == 0), lambda x, y: x.k == y.k or x.k == 0),
    ]
    for on, plain in conditions:
        inner = [(x, y) for x in a for y in b if plain(x, y)]
        left = [(x, None) for x in a if not any(plain(x, y) for y in b)]
        right = [(None, y) for y in b if not any(plain(x, y) for x in a)]
        assert multiset(l.join(r, on).collect()) == multiset(inner)
        assert multiset(l.left_join(r, on).collect()) == multiset(inner + left)
        assert multiset(l.right_join(r, on).collect()) == multiset(inner + right)
        assert multiset(l.full_join(r, on).collect()) == multiset(inner + left + right)
        assert multiset(l.anti_join(r, on).collect()) == multiset([x for x, _ in left])
        assert l.join(l, lambda x, y: x.k == y.k).count().collect_value() == sum(x.k == y.k for x in a for y in a)


def test_a_matched_null_is_no_missing_row(spark):
    one, two = Dataset.of_rows(spark, int, [1, 2]), Dataset.of_rows(spark, Opt(LONG), [None])
    joined = one.left_join(two, lambda a, b: (a == lit(1, LONG)) & b.is_empty())
    assert multiset(joined.collect()) == [(1, Some(None)), (2, None)]


def test_pair_joins(spark):
    l = Dataset.of_rows(spark, product(k=INT, v=STRING), [(1, "a"), (2, "b")])
    r = Dataset.of_rows(spark, product(k=INT, w=STRING), [(2, "x"), (3, "y")])
    assert l.join_pairs(r).collect() == [(2, ("b", "x"))]
    assert multiset(l.full_join_pairs(r).collect()) == [(1, ("a", None)), (2, ("b", "x")), (3, (None, "y"))]
    assert multiset(l.right_join_pairs(r).collect()) == [(2, ("b", "x")), (3, (None, "y"))]
    assert l.anti_join_pairs(r).collect() == [{"k": 1, "v": "a"}]
    with pytest.raises(TypeProblem):
        l.join_flat(l, lambda a, b: a.k == b.k)


def test_aggregates_on_empty_and_null(spark, sides):
    rows = Dataset.of_rows(spark, Pair, sides[0])
    values = [p.v for p in sides[0]]
    n, total, kept, distinct = rows.aggregate(lambda r: A.count(), lambda r: A.sum_(r.v), lambda r: A.collect(r.v), lambda r: A.count_distinct(r.v)).collect_value()
    assert (n, total, multiset(kept), distinct) == (12, sum(v for v in values if v is not None), multiset(values), len({v for v in values if v is not None}))
    empty = Dataset.empty(spark, Pair)
    assert empty.aggregate(lambda r: A.count()).collect_value() is None
    assert empty.count().collect_value() == 0
    assert empty.group_by_key(lambda r: lit(1)).count().collect() == []
    assert empty.group_by().aggregate(n=lambda r: A.count()).collect() == []
    assert Dataset.of_rows(spark, Opt(INT), [None]).aggregate(lambda x: A.sum_(x)).collect_value() == Some(None)


def test_sum_overflow_is_an_error(spark):
    with pytest.raises(Exception, match="(?i)overflow"):
        Dataset.of_rows(spark, int, [2**63 - 1, 1]).aggregate(lambda x: A.sum_(x)).collect()
    big = Dataset.of_rows(spark, Dec(38, 0), [__import__("decimal").Decimal(10**38 - 1), __import__("decimal").Decimal(1)])
    with pytest.raises(Exception, match="(?i)overflow|out of range|NUMERIC_VALUE"):
        big.aggregate(lambda x: A.sum_(x)).collect()


def test_reduce_in_two_steps(spark):
    rows = [(i % 3, i) for i in range(200)]
    ds = Dataset.of_rows(spark, product(k=INT, v=INT), rows)
    out = ds.reduce(lambda a, b: a + b).collect()
    assert multiset(out) == [{"key": k, "value": sum(v for j, v in rows if j == k)} for k in range(3)]


def test_struct_keys_and_wrong_groupings(spark, sides):
    ds = Dataset.of_rows(spark, Pair, sides[0])
    counted = {r["key"]: r["count"] for r in ds.group_by_key(lambda r: tuple_(r.k, r.v)).count().collect()}
    assert counted == {(p.k, p.v): sum(q == p for q in sides[0]) for p in sides[0]}
    held = Dataset.of_rows(spark, product(m=Map(STRING, INT)), [({"a": 1},)])
    for wrong in (lambda: held.group_by_key(lambda r: r.m), lambda: held.distinct(), lambda: held.except_(held), lambda: held.order_by(lambda r: r.m), lambda: held.aggregate(lambda r: A.count_distinct(r.m)), lambda: ds.group_by(k=lambda r: r.k).aggregate(k=lambda r: A.count()), lambda: ds.aggregate(lambda r: A.sum_(r.v.is_empty()))):
        with pytest.raises(TypeProblem):
            wrong()


def test_order(spark):
    values = [None, float("nan"), float("inf"), float("-inf"), 1.0]
    got = Dataset.of_rows(spark, Opt(DOUBLE), values).order_by(lambda x: x).collect()
    assert got[0] is None and got[1:4] == [float("-inf"), 1.0, float("inf")] and got[4] != got[4]
    rows = [(2, "a"), (1, "b"), (1, "a")]
    assert Dataset.of_rows(spark, product(a=INT, b=STRING), rows).order_by(lambda r: r).select(lambda r: tuple_(r.a, r.b)).collect() == sorted(rows)
    with pytest.warns(UserWarning):
        Dataset.of_rows(spark, int, [1]).limit(10_001)


def test_explode_and_sets(spark):
    ds = Dataset.of_rows(spark, product(a=INT, s=list[int]), [(1, [5, 6]), (2, [])])
    assert ds.select(lambda r: r.a, lambda r: explode(r.s), lambda r: explode(seq("x", "y"))).count().collect_value() == 4
    assert ds.explode(lambda r: when(r.a > 1, r.a)).collect() == [2]
    ints = Dataset.of_rows(spark, int, [1, 1, 2, 3])
    assert multiset(ints.except_(Dataset.of_rows(spark, int, [3])).collect()) == [1, 2]
    assert multiset(ints.union(ints).collect()) == [1, 1, 1, 1, 2, 2, 3, 3]


def test_opaque_functions(spark, sides):
    ds = Dataset.of_rows(spark, Pair, sides[0])
    assert multiset(ds.map(lambda p: Pair(p.k + 1, p.v), Pair).collect()) == multiset([Pair(p.k + 1, p.v) for p in sides[0]])
    assert multiset(ds.filter(lambda p: p.v is None).collect()) == multiset([p for p in sides[0] if p.v is None])
    assert ds.flat_map(lambda p: [p.k] * 2, Int).count().collect_value() == 24


def exchanges(ds: Dataset) -> int:
    frame = ds.to_df()
    frame.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    frame.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return frame.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    finally:
        frame.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        frame.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")


def test_shuffles_are_reused(spark, tmp_path):
    a, b, c = (Dataset.of_df(spark.range(50).selectExpr(f"cast(id % 5 as int) k{n}", f"id v{n}"), product(**{f"k{n}": INT, f"v{n}": LONG})) for n in range(3))
    joined = a.join_flat(b, lambda x, y: x.k0 == y.k1)
    assert exchanges(joined.join_flat(c, lambda x, y: x.k0 == y.k2)) == 3
    assert exchanges(a.join(b, lambda x, y: x.k0 == y.k1).join(c, lambda x, y: x._1.opened().k0 == y.k2)) == 3
    assert exchanges(joined.group_by(k=lambda r: r.k0).aggregate(n=lambda r: A.count())) == 2


def test_filters_and_columns_reach_the_scan(spark):
    ds = Dataset.of_df(spark.read.parquet("/root/testdata/sf0.001/orders.parquet"))
    plan = ds.where(lambda o: o.o_totalprice.exists(lambda p: p > 1000.0)).select(lambda o: o.o_orderkey).explain("formatted")
    assert "PushedFilters: [" in plan and "GreaterThan(o_totalprice,1000.0)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_cache_is_given_back(spark):
    ds = Dataset.of_df(spark.range(10).selectExpr("id as a"), product(a=LONG)).cache()
    counted = ds.join(ds, lambda x, y: x.a == y.a)
    assert counted.count().collect_value() == 10
    assert counted.to_df()._jdf.queryExecution().executedPlan().toString().count("InMemoryTableScan") == 2
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    del ds, counted
    gc.collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() < before


def test_subqueries_are_lazy_and_single(spark):
    ds = Dataset.of_rows(spark, int, [1, 2, 3])
    one = Dataset.single(spark, int, 7)
    assert ds.where(lambda x: x == lit(2, LONG)).select(lambda x: named(x=x, seven=one.value)).collect() == [{"x": 2, "seven": 7}]
    assert ds.where(lambda x: Dataset.empty(spark, int).exists()).collect() == []
    assert isinstance(ds.exists(), E) and ds.exists().kind == BOOL
