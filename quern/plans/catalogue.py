"""The query catalogue: one Spark query per capability, with the SQL that states the same result."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import aggregates as A
from quern.functions.expr import E, as_base, cases, coalesce, days_to_date, larger, lit, make, make_map, micros_to_timestamp, named, none, range_, seq, smaller, some, sql_column, ternary, tuple_, when
from quern.functions.json import from_json, to_json
from quern.operators.dataset import Dataset, explode
from quern.plans.models import TABLES
from quern.sources import io
from quern.sources import partitions as hive
from quern.types import BINARY, BYTE, DATE, DOUBLE, INT, LONG, STRING, Dec, Int, Long, Product, sealed

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> Dataset:
    return Dataset.of_df(spark.read.parquet(f"{sf_dir}/{name}.parquet"), TABLES[name])


def query(sql: str | None = None):
    """Register fn(t) -> Dataset, where t(name) is a table; `sql` states the same result."""

    def add(fn: Callable) -> Callable:
        _QUERIES[fn.__name__] = lambda spark, sf_dir: fn(lambda name: table(spark, sf_dir, name)).to_df()
        if sql:
            _ORACLES[fn.__name__] = sql
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


# --- relational -----------------------------------------------------------------------------------------------------


@query("SELECT c_mktsegment, o_orderpriority, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 1000 GROUP BY ALL")
def segment_priority_revenue(t):
    joined = t("customer").join(t("orders").where(lambda o: o.o_totalprice > 1000.0), lambda c, o: c.c_custkey == o.o_custkey)
    return joined.group_by(c_mktsegment=lambda r: r._1.c_mktsegment, o_orderpriority=lambda r: r._2.o_orderpriority).aggregate(n_orders=lambda _: A.count(), revenue=lambda r: rounded(A.sum_(r._2.o_totalprice)))


def rounded(e: E, digits: int = 2) -> E:
    """A Spark function without a typed form."""
    return E(e.kind, F.round(e.col, digits), agg=e.agg)


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def scan_project(t):
    return t("orders").select(lambda o: named(o_orderkey=o.o_orderkey, o_orderstatus=o.o_orderstatus, o_totalprice=o.o_totalprice))


@query("SELECT * FROM customer WHERE (c_acctbal > 5000 AND c_mktsegment = 'BUILDING') OR c_nationkey = 3")
def filter_compound(t):
    return t("customer").where(lambda c: ((c.c_acctbal > 5000.0) & (c.c_mktsegment == "BUILDING")) | (c.c_nationkey == 3))


@query("SELECT l_orderkey AS _1, l_linenumber AS _2, l_quantity AS _3, l_returnflag AS _4, l_linestatus AS _5 FROM lineitem")
def select_n(t):
    return t("lineitem").select(lambda r: r.l_orderkey, lambda r: r.l_linenumber, lambda r: r.l_quantity, lambda r: r.l_returnflag, lambda r: r.l_linestatus)


@dataclass
class PartName:
    p_partkey: Long
    p_name: str


@query("SELECT p_partkey, p_name FROM part")
def project_subset(t):
    return t("part").project(PartName)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100")
def order_limit_topk(t):
    return t("orders").order_by(lambda o: o.o_totalprice, lambda o: o.o_orderkey).limit(100).select(lambda o: named(o_orderkey=o.o_orderkey, o_totalprice=o.o_totalprice))


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation")
def union_all(t):
    nations = t("nation").select(lambda n: named(name=n.n_name))
    return nations.union(t("region").select(lambda r: named(name=r.r_name))).union(nations)


@query("SELECT c_nationkey AS value FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 6000")
def except_distinct(t):
    return t("customer").select(lambda c: c.c_nationkey).except_(t("supplier").where(lambda s: s.s_acctbal > 6000.0).select(lambda s: s.s_nationkey))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(t):
    return t("lineitem").select(lambda r: named(l_returnflag=r.l_returnflag, l_linestatus=r.l_linestatus)).distinct()


@query("SELECT n_regionkey AS _1, upper_len AS _2 FROM (SELECT n_regionkey, n_name || '!' AS upper_len FROM nation)")
def key_by_values(t):
    return t("nation").key_by(lambda n: n.n_regionkey).select_values(lambda n: n.n_name.concat("!"))


@query("SELECT n_regionkey AS value FROM nation")
def keys_only(t):
    return t("nation").key_by(lambda n: n.n_regionkey).keys()


@query("SELECT n_nationkey AS _1, n_name AS _2 FROM nation")
def pairs_of_two(t):
    return t("nation").select(lambda n: named(key=n.n_nationkey, value=n.n_name)).pairs()


@query('SELECT p_partkey, "column", "value" FROM (SELECT p_partkey, p_name, p_brand, p_type FROM part) UNPIVOT ("value" FOR "column" IN (p_name, p_brand, p_type))')
def unpivot_part(t):
    df = t("part").select(lambda p: named(p_partkey=p.p_partkey, p_name=p.p_name, p_brand=p.p_brand, p_type=p.p_type)).to_df()
    return io.unpivot(df, Product((("p_partkey", LONG), ("column", STRING), ("value", STRING))))


@query("SELECT c_custkey, c_name, c_acctbal, 'none' AS c_mktsegment, c_nationkey + 1 AS c_nationkey, c_custkey + 5 AS further FROM customer")
def copy_update_struct(t):
    return t("customer").select(lambda c: c.copy(c_mktsegment="none")).select(lambda c: c.update(c_nationkey=c.c_nationkey + 1, further=c.c_custkey + lit(5, LONG)))


@query("SELECT n_name, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def merge_and_remove(t):
    joined = t("nation").join(t("region"), lambda n, r: n.n_regionkey == r.r_regionkey)
    return joined.select(lambda x: x._1.project(Product((("n_name", STRING), ("n_regionkey", INT)))).merge(x._2.opened().remove_kind(INT)))


# --- joins ----------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, l_linenumber, c_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 45")
def join_inner_multi(t):
    lines = t("lineitem").where(lambda x: x.l_quantity > 45.0)
    joined = t("customer").join_flat(t("orders"), lambda c, o: c.c_custkey == o.o_custkey).join_flat(lines, lambda a, x: a.o_orderkey == x.l_orderkey)
    return joined.select(lambda r: named(o_orderkey=r.o_orderkey, l_linenumber=r.l_linenumber, c_name=r.c_name))


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS labelled, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_left_option(t):
    joined = t("documents").left_join(t("labels"), lambda d, x: d.doc_id == x.doc_id)
    return joined.select(lambda r: named(doc_id=r._1.doc_id, labelled=~r._2.is_empty(), quality=r._2.map(lambda x: x.quality).get_or_else(-1)))


@query("SELECT s.s_suppkey, n.n_nationkey FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 9000")
def join_right(t):
    joined = t("supplier").right_join(t("nation"), lambda s, n: (s.s_nationkey == n.n_nationkey) & (s.s_acctbal > 9000.0))
    return joined.select(lambda r: named(s_suppkey=r._1.map(lambda s: s.s_suppkey), n_nationkey=r._2.n_nationkey))


@query("SELECT coalesce(a.k, b.k) AS _key, a.n AS left_n, b.n AS right_n FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9900 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def join_full_coalesce_key(t):
    left = t("customer").where(lambda c: c.c_acctbal > 9900.0).group_by(k=lambda c: c.c_nationkey).count()
    right = t("supplier").group_by(k=lambda s: s.s_nationkey).count()
    return left.full_join_pairs(right).select(lambda r: named(_key=r._1, left_n=r._2.opened()._1, right_n=r._2.opened()._2))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_anti(t):
    return t("customer").anti_join(t("orders").where(lambda o: o.o_totalprice > 300000.0), lambda c, o: c.c_custkey == o.o_custkey).select(lambda c: named(c_custkey=c.c_custkey))


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey")
def join_theta(t):
    return t("nation").join(t("region"), lambda n, r: n.n_regionkey < r.r_regionkey).select(lambda x: named(n_name=x._1.n_name, r_name=x._2.r_name))


@query("SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_extendedprice > o_totalprice / 2")
def join_equi_residual(t):
    joined = t("orders").join(t("lineitem"), lambda o, x: (o.o_orderkey == x.l_orderkey) & (x.l_extendedprice > sql_column(o.o_totalprice.col / 2, DOUBLE)))
    return joined.select(lambda r: named(o_orderkey=r._1.o_orderkey, l_linenumber=r._2.l_linenumber))


@query("SELECT a.n_name AS one, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self_nation(t):
    nation = t("nation")
    joined = nation.join(nation, lambda a, b: (a.n_regionkey == b.n_regionkey) & (a.n_nationkey < b.n_nationkey))
    return joined.select(lambda r: named(one=r._1.n_name, other=r._2.n_name))


@query("SELECT s_name, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey > 2 LEFT JOIN region ON n_regionkey = r_regionkey")
def join_flat_three_way(t):
    one = t("supplier").left_join_flat(t("nation"), lambda s, n: (s.s_nationkey == n.n_nationkey) & (n.n_regionkey > 2))
    two = one.left_join_flat(t("region"), lambda a, r: a.n_regionkey == some(r.r_regionkey))
    return two.select(lambda r: named(s_name=r.s_name, n_name=r.n_name, r_name=r.r_name))


@query("SELECT count(*) AS pairs FROM (SELECT nullif(c_nationkey, 7) AS k FROM customer) a JOIN (SELECT nullif(s_nationkey, 7) AS k FROM supplier) b ON a.k IS NOT DISTINCT FROM b.k")
def join_null_safe(t):
    seven = lambda e: when(e != 7, e)
    left = t("customer").group_by(k=lambda c: seven(c.c_nationkey)).aggregate(n=lambda _: A.count())  # a key's rows are counted first, so the join makes one row for each supplier
    right = t("supplier").select(lambda s: named(k=seven(s.s_nationkey)))
    pairs = left.join(right, lambda a, b: a.k == b.k).aggregate(lambda r: A.sum_(r._1.n))
    return pairs.select(lambda n: named(pairs=n.get_or_else(lit(0, LONG))))


@query("SELECT n_regionkey AS _1, n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_pairs(t):
    left = t("nation").select(lambda n: n.n_regionkey, lambda n: n.n_name)
    right = t("region").select(lambda r: r.r_regionkey, lambda r: r.r_name)
    return left.join_pairs(right).select(lambda r: named(_1=r._1, a=r._2.opened()._1, b=r._2.opened()._2))


@query("SELECT n_nationkey AS _1, n_name AS a, s_name AS b FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 8000) ON n_nationkey = s_nationkey")
def join_left_pairs(t):
    left = t("nation").select(lambda n: n.n_nationkey, lambda n: n.n_name)
    right = t("supplier").where(lambda s: s.s_acctbal > 8000.0).select(lambda s: s.s_nationkey, lambda s: s.s_name)
    return left.left_join_pairs(right).select(lambda r: named(_1=r._1, a=r._2.opened()._1, b=r._2.opened()._2))


@query("SELECT n_nationkey AS _1, n_name AS _2 FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def join_anti_pairs(t):
    left = t("nation").select(lambda n: n.n_nationkey, lambda n: n.n_name)
    return left.anti_join_pairs(t("supplier").where(lambda s: s.s_acctbal > 5000.0).select(lambda s: s.s_nationkey, lambda s: s.s_name))


# --- aggregates -----------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS n, round(sum(l_quantity), 2) AS quantity, min(l_extendedprice) AS least, max(l_linenumber) AS most FROM lineitem")
def agg_global(t):
    one = t("lineitem").aggregate(lambda r: named(n=A.count(), quantity=rounded(A.sum_(r.l_quantity)), least=A.min_(r.l_extendedprice), most=A.max_(r.l_linenumber)))
    return one.select(lambda r: r.spread_option())


@query("SELECT NULL::BIGINT AS value")
def agg_global_empty(t):
    return t("lineitem").where(lambda r: r.l_quantity < -1.0).aggregate(lambda r: A.count())


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS many, count(CASE WHEN l_discount > 0.05 THEN 1 END) AS cheap FROM lineitem GROUP BY 1")
def agg_count_if_some(t):
    return t("lineitem").group_by(l_returnflag=lambda r: r.l_returnflag).aggregate(many=lambda r: A.count_if(r.l_quantity > 25.0), cheap=lambda r: A.count_some(when(r.l_discount > 0.05, r.l_tax)))


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def agg_count_distinct(t):
    return t("orders").group_by(o_orderpriority=lambda o: o.o_orderpriority).aggregate(customers=lambda o: A.count_distinct(o.o_custkey))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem)")
def agg_count_distinct_struct(t):
    return t("lineitem").aggregate(lambda r: A.count_distinct(tuple_(r.l_returnflag, r.l_linestatus, r.l_linenumber))).select(lambda n: named(n=n.expect("no rows")))


@query("SELECT p_brand, min(p_size) AS least, max(p_retailprice) AS most, min(p_name) AS first_name FROM part GROUP BY 1")
def agg_min_max(t):
    return t("part").group_by(p_brand=lambda p: p.p_brand).aggregate(least=lambda p: A.min_(p.p_size), most=lambda p: A.max_(p.p_retailprice), first_name=lambda p: A.min_(p.p_name))


@query("SELECT c_nationkey, arg_min(c_name, {'a': c_acctbal, 'b': c_custkey}) AS poorest, arg_max(c_name, {'a': c_acctbal, 'b': c_custkey}) AS richest FROM customer GROUP BY 1")
def agg_min_by_max_by(t):
    by = lambda c: tuple_(c.c_acctbal, c.c_custkey)
    return t("customer").group_by(c_nationkey=lambda c: c.c_nationkey).aggregate(poorest=lambda c: A.min_by(c.c_name, by(c)), richest=lambda c: A.max_by(c.c_name, by(c)))


@query("SELECT quality, bool_and(toxic = 0) AS all_clean, bool_or(toxic = 1) AS any_toxic FROM labels GROUP BY 1")
def agg_bool(t):
    return t("labels").group_by(quality=lambda r: r.quality).aggregate(all_clean=lambda r: A.bool_and(r.toxic == 0), any_toxic=lambda r: A.bool_or(r.toxic == 1))


@query("SELECT l_linestatus, sum(l_linenumber)::BIGINT AS ints, sum(l_orderkey)::BIGINT AS longs, round(sum(l_tax), 4) AS doubles, sum(l_linenumber::DECIMAL(38, 2))::DECIMAL(38, 2)::VARCHAR AS decimals FROM lineitem GROUP BY 1")
def agg_sum_types(t):
    text = lambda e: E(STRING, e.col.cast("string"), agg=True)
    return t("lineitem").group_by(l_linestatus=lambda r: r.l_linestatus).aggregate(
        ints=lambda r: A.sum_(r.l_linenumber), longs=lambda r: A.sum_(r.l_orderkey), doubles=lambda r: rounded(A.sum_(r.l_tax), 4), decimals=lambda r: text(A.sum_(r.l_linenumber.cast(Dec(38, 2))))
    )


def in_order(e: E, separator: str = ",") -> E:
    """A sequence of strings as one sorted text."""
    return E(STRING, F.array_join(F.sort_array(e.col), separator), agg=e.agg)


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def agg_collect_sorted(t):
    return t("nation").group_by(n_regionkey=lambda n: n.n_regionkey).aggregate(names=lambda n: in_order(A.collect(n.n_name)))


@query("SELECT n_regionkey, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT n_regionkey, unnest([n_name, n_name || '2']) AS x FROM nation) GROUP BY 1")
def agg_concat_seq(t):
    return t("nation").group_by(n_regionkey=lambda n: n.n_regionkey).aggregate(names=lambda n: in_order(A.concat(seq(n.n_name, n.n_name.concat("2")))))


@query("SELECT o_orderstatus AS key, max(o_totalprice) AS value FROM orders GROUP BY 1")
def agg_reduce(t):
    return t("orders").group_by_key(lambda o: o.o_orderstatus).select_values(lambda o: o.o_totalprice).reduce(larger)


@query("SELECT l_returnflag, (sum(l_linenumber) + count(*))::BIGINT AS total, 'x' || min(l_linestatus) AS label FROM lineitem GROUP BY 1")
def agg_then_expr(t):
    return t("lineitem").group_by(l_returnflag=lambda r: r.l_returnflag).aggregate(total=lambda r: A.sum_(r.l_linenumber) + A.count(), label=lambda r: lit("x").concat(A.min_(r.l_linestatus)))


@query("SELECT o_orderkey // 1000 AS bucket, o_orderstatus = 'F' AS done, count(*) AS n FROM orders GROUP BY ALL")
def agg_group_by_expr(t):
    return t("orders").group_by(bucket=lambda o: o.o_orderkey // lit(1000, LONG), done=lambda o: o.o_orderstatus == "F").aggregate(n=lambda _: A.count())


@query("SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
def agg_nested_two_level(t):
    return t("orders").group_by(k=lambda o: o.o_custkey).aggregate(n=lambda _: A.count()).group_by(n=lambda r: r.n).aggregate(customers=lambda _: A.count())


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15")
def agg_having(t):
    return t("orders").group_by(o_custkey=lambda o: o.o_custkey).aggregate(n=lambda _: A.count()).where(lambda r: r.n > lit(15, LONG))


@query("SELECT k AS key, count(*) AS count FROM (SELECT nullif(c_nationkey, 3) AS k FROM customer) GROUP BY 1")
def agg_option_key(t):
    return t("customer").group_by_key(lambda c: when(c.c_nationkey != 3, c.c_nationkey)).count()


@query("SELECT a, b, n FROM (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY ALL)")
def agg_struct_key(t):
    counted = t("lineitem").group_by_key(lambda r: tuple_(r.l_returnflag, r.l_linestatus)).count()
    return counted.select(lambda r: named(a=r.key.opened()._1, b=r.key.opened()._2, n=r["count"]))


@query("SELECT 5 AS key, count(*) AS count FROM region")
def agg_literal_key(t):
    return t("region").group_by_key(lambda r: lit(5)).count()


# --- scalars --------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, len(string_split(p_type, ' '))::INTEGER AS n, string_split(p_type, ' ')[1] AS first FROM part")
def str_split(t):
    return t("part").select(lambda p: named(p_partkey=p.p_partkey, n=p.p_type.split(" ").size(), first=p.p_type.split(" ").get(0)))


@query("SELECT p_partkey, trim('  ' || p_name || ' ', ' ') AS trimmed, starts_with(p_type, 'S') AS s, ends_with(p_type, 'R') AS e FROM part")
def str_trim_prefix_suffix(t):
    return t("part").select(lambda p: named(p_partkey=p.p_partkey, trimmed=lit("  ").concat(p.p_name, " ").trim(), s=p.p_type.starts_with("S"), e=p.p_type.ends_with("R")))


@query("SELECT c_custkey, c_name || '/' || c_mktsegment AS label FROM customer")
def str_concat(t):
    return t("customer").select(lambda c: named(c_custkey=c.c_custkey, label=c.c_name.concat("/", c.c_mktsegment)))


@query("SELECT l_orderkey, l_linenumber, l_linenumber + 7 AS added, (l_orderkey - 20000) // 7 AS divided FROM lineitem")
def num_add_div(t):
    return t("lineitem").select(lambda r: named(l_orderkey=r.l_orderkey, l_linenumber=r.l_linenumber, added=r.l_linenumber + 7, divided=(r.l_orderkey + lit(-20000, LONG)) // lit(7, LONG)))


@query("SELECT p_partkey, p_size::BIGINT AS long, p_size::DOUBLE AS double, p_size::VARCHAR AS text, p_size::DECIMAL(12, 2)::VARCHAR AS decimal FROM part")
def cast_widen(t):
    return t("part").select(lambda p: named(p_partkey=p.p_partkey, long=p.p_size.cast(LONG), double=p.p_size.cast(DOUBLE), text=p.p_size.cast(STRING), decimal=E(STRING, p.p_size.cast(Dec(12, 2)).col.cast("string"))))


@query("SELECT p_partkey, CASE WHEN regexp_full_match(s, ' *[+-]?[0-9]+ *') THEN try_cast(trim(s) AS INTEGER) END AS number FROM (SELECT p_partkey, unnest([p_size::VARCHAR, ' ' || p_size, p_size || '.5', p_name, '99999999999']) AS s FROM part)")
def try_cast_string(t):
    texts = t("part").select(lambda p: p.p_partkey, lambda p: explode(seq(p.p_size.cast(STRING), lit(" ").concat(p.p_size.cast(STRING)), p.p_size.cast(STRING).concat(".5"), p.p_name, lit("99999999999"))))
    return texts.select(lambda r: named(p_partkey=r._1, number=r._2.try_cast(INT)))


@query("SELECT p_partkey, CASE WHEN p_size < 50 THEN p_size END::TINYINT::INTEGER AS small, round(p_retailprice::DECIMAL(20, 4), 0)::BIGINT AS rounded FROM (SELECT * REPLACE (CASE WHEN p_size >= 50 THEN 1000 ELSE p_size END AS p_size) FROM part)")
def try_cast_decimal(t):
    def narrow(p):
        size = ternary(p.p_size >= 50, 1000, p.p_size)
        price = p.p_retailprice.try_cast(Dec(20, 4))
        return named(p_partkey=p.p_partkey, small=size.try_cast(BYTE).map(lambda b: b.cast(INT)), rounded=price.flat_map(lambda d: d.try_cast(LONG)))

    return t("part").select(narrow)


@query("SELECT o_orderkey, datediff('day', DATE '1970-01-01', o_orderdate::DATE)::INTEGER AS days, (o_orderdate::DATE + 3)::VARCHAR AS later FROM orders")
def date_days(t):
    def days(o):
        d = sql_column(o.o_orderdate.col.cast("date"), DATE)
        return named(o_orderkey=o.o_orderkey, days=d.to_days(), later=E(STRING, days_to_date(d.to_days() + 3).col.cast("string")))

    return t("orders").select(days)


@query("SELECT event_id, epoch_us(ts) AS micros, epoch_us(ts) + 1500000 AS later FROM events")
def ts_micros(t):
    return t("events").select(lambda e: named(event_id=e.event_id, micros=e.ts.to_micros(), later=micros_to_timestamp(e.ts.to_micros() + lit(1_500_000, LONG)).to_micros()))


@query("SELECT c_custkey, to_base64(encode(c_name)) AS coded, c_name AS back, octet_length(encode(c_name))::INTEGER AS n FROM customer")
def base64_roundtrip(t):
    def both(c):
        raw = c.c_name.cast(BINARY)
        back = raw.to_base64().from_base64().expect("no base64")
        return named(c_custkey=c.c_custkey, coded=raw.to_base64(), back=E(STRING, F.decode(back.col, "utf-8")), n=raw.length())

    return t("customer").select(both)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS size, CASE WHEN l_tax > 0.05 THEN l_tax END AS tax FROM lineitem")
def case_when(t):
    return t("lineitem").select(lambda r: named(l_orderkey=r.l_orderkey, l_linenumber=r.l_linenumber, size=cases().when(r.l_quantity < 10.0, "small").when(r.l_quantity < 30.0, "medium").otherwise("large"), tax=when(r.l_tax > 0.05, r.l_tax)))


@query("SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_name END, CASE WHEN c_nationkey > 10 THEN c_mktsegment END, 'nothing') AS label, c_acctbal > 0 AND length(c_name) > 0 AS both FROM customer")
def coalesce_option(t):
    def label(c):
        name, segment = when(c.c_acctbal > 0.0, c.c_name), when(c.c_nationkey > 10, c.c_mktsegment)
        return named(c_custkey=c.c_custkey, label=coalesce(name, segment).get_or_else("nothing"), both=name.exists(lambda n: n != ""))

    return t("customer").select(label)


@query("SELECT l_orderkey, l_linenumber, l_quantity = 17 AS odd FROM lineitem")
def is_nan(t):
    return t("lineitem").select(lambda r: named(l_orderkey=r.l_orderkey, l_linenumber=r.l_linenumber, odd=ternary(r.l_quantity == 17.0, float("nan"), r.l_tax).is_nan()))


@query("SELECT l_orderkey, l_linenumber, least(l_discount, l_tax) AS low, greatest(l_discount, l_tax) AS high FROM lineitem")
def smaller_larger(t):
    return t("lineitem").select(lambda r: named(l_orderkey=r.l_orderkey, l_linenumber=r.l_linenumber, low=smaller(r.l_discount, r.l_tax), high=larger(r.l_discount, r.l_tax)))


@query("SELECT c_custkey, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a || b END AS zipped, coalesce(b = 'BUILDING', false) AS building, coalesce(a, b) AS either FROM (SELECT c_custkey, CASE WHEN c_acctbal > 2000 THEN c_name END AS a, CASE WHEN c_nationkey < 12 THEN c_mktsegment END AS b FROM customer)")
def option_ops(t):
    def ops(c):
        a, b = when(c.c_acctbal > 2000.0, c.c_name), when(c.c_nationkey < 12, c.c_mktsegment)
        return named(c_custkey=c.c_custkey, zipped=a.zip(b).map(lambda p: p._1.concat(p._2)), building=b.contains("BUILDING"), either=a.or_else(b))

    return t("customer").select(ops)


# --- nested ---------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, len(w)::INTEGER AS n, len(list_filter(w, lambda x: starts_with(x, 't')))::INTEGER AS t, array_to_string(list_transform(w[1:3], lambda x: x || '!'), ' ') AS first FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def arr_map_filter(t):
    def words(d):
        w = d.text.split(" ")
        first = E(w.kind, F.slice(w.col, 1, 3))
        return named(doc_id=d.doc_id, n=w.size(), t=w.filter(lambda x: x.starts_with("t")).size(), first=first.map(lambda x: x.concat("!")).mk_string(" "))

    return t("documents").select(words)


@query("SELECT doc_id, len(list_filter(w, lambda x: length(x) = 0)) = 0 AS full_words, list_contains(w, 'the') AS has_the, len(list_filter(w, lambda x: ends_with(x, 'ing'))) > 0 AS has_ing FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def arr_forall_exists_contains(t):
    def tests(d):
        w = d.text.split(" ")
        return named(doc_id=d.doc_id, full_words=w.forall(lambda x: x != ""), has_the=w.contains("the"), has_ing=w.exists(lambda x: x.ends_with("ing")))

    return t("documents").select(tests)


@query("SELECT p_partkey, least(len(a), 2)::INTEGER AS n, a[1] || '-1' AS first FROM (SELECT p_partkey, string_split(p_type, ' ') AS a FROM part)")
def arr_zip(t):
    def zipped(p):
        z = p.p_type.split(" ").zip(seq(1, 2))
        return named(p_partkey=p.p_partkey, n=z.size(), first=z.map(lambda x: x._1.concat("-", x._2.cast(STRING))).get(0))

    return t("part").select(zipped)


@query("SELECT doc_id, len(list_distinct(string_split(text, ' ')))::INTEGER AS n FROM documents")
def arr_distinct(t):
    return t("documents").select(lambda d: named(doc_id=d.doc_id, n=d.text.split(" ").distinct().size()))


@query("SELECT vec_id, embedding[1]::DOUBLE AS first, embedding[64]::DOUBLE AS last, len(embedding)::INTEGER AS n FROM embeddings")
def arr_get_size(t):
    return t("embeddings").select(lambda v: named(vec_id=v.vec_id, first=v.embedding.get(0).cast(DOUBLE), last=v.embedding.get(63).cast(DOUBLE), n=v.embedding.size()))


@query("SELECT p_partkey, array_to_string(list_transform(range(0, (p_size % 7)::BIGINT), lambda x: x::VARCHAR), ',') AS up FROM part")
def arr_range(t):
    return t("part").select(lambda p: named(p_partkey=p.p_partkey, up=range_(lit(0), sql_column(p.p_size.col % 7, INT)).map(lambda x: x.cast(STRING)).mk_string(",")))


@query("SELECT n_nationkey, array_to_string([n_name, n_name || 'x', 'end'], '|') AS joined FROM nation")
def arr_mkstring(t):
    return t("nation").select(lambda n: named(n_nationkey=n.n_nationkey, joined=seq(n.n_name, n.n_name.concat("x")).concat(seq("end")).mk_string("|")))


@query("SELECT doc_id, sum(length(w))::BIGINT AS letters FROM (SELECT doc_id, unnest(string_split(l, ' ')) AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)) GROUP BY 1")
def arr_flat_map(t):
    words = t("documents").select(lambda d: d.doc_id, lambda d: explode(d.text.split("\n").flat_map(lambda x: x.split(" "))))
    return words.group_by(doc_id=lambda r: r._1).aggregate(letters=lambda r: A.sum_(sql_column(F.length(r._2.col), INT)))


@query("SELECT n_nationkey, n_name AS found, NULL::VARCHAR AS missing, 2 AS n FROM nation")
def map_get_entries(t):
    def look(n):
        m = make_map(("name", n.n_name), ("key", n.n_nationkey.cast(STRING)))
        return named(n_nationkey=n.n_nationkey, found=m.get("name"), missing=m.get("other"), n=m.entries().size())

    return t("nation").select(look)


@query("SELECT c_custkey, c_name AS inner_name, c_acctbal AS inner_balance FROM customer")
def struct_fields(t):
    packed = t("customer").select(lambda c: named(c_custkey=c.c_custkey, inside=named(name=c.c_name, balance=c.c_acctbal)))
    return packed.select(lambda r: named(c_custkey=r.c_custkey, inner_name=r.inside.opened().name, inner_balance=r.inside.opened().balance))


@dataclass
class Props:
    k: Long


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_parse_props(t):
    return t("events").select(lambda e: named(event_id=e.event_id, k=from_json(e.props, Props).map(lambda p: p.k)))


@dataclass
class Wire:
    id: Long
    name: str
    tags: list[str]
    counts: dict[str, Int]
    note: str | None


@query("SELECT n_nationkey, n_name AS name, 2 AS tags, n_regionkey AS count, NULL::VARCHAR AS note, true AS broken FROM nation")
def json_roundtrip(t):
    def trip(n):
        value = make(Wire, id=n.n_nationkey.cast(LONG), name=n.n_name, tags=seq(n.n_name, "x"), counts=make_map(("a", n.n_regionkey)), note=none(STRING))
        back = from_json(to_json(value), Wire).expect("no round trip")
        broken = from_json(lit('{"id": 1, "name": "x"}'), Wire).is_empty()
        return named(n_nationkey=n.n_nationkey, name=back.name, tags=back.tags.size(), count=back.counts.get("a").expect("no a"), note=back.note, broken=broken)

    return t("nation").select(trip)


@sealed
class Balance:
    pass


@dataclass
class Debt(Balance):
    amount: float


@dataclass
class Credit(Balance):
    amount: float
    segment: str


class Even(Balance):
    pass


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 3000 THEN c_mktsegment ELSE 'even' END AS label FROM customer")
def sum_type_cases(t):
    def balance(c):
        debt = as_base(Balance, "debt", make(Debt, amount=c.c_acctbal))
        credit = as_base(Balance, "credit", make(Credit, amount=c.c_acctbal, segment=c.c_mktsegment))
        return cases().when(c.c_acctbal < 0.0, debt).when(c.c_acctbal > 3000.0, credit).otherwise(as_base(Balance, "even"))

    held = t("customer").select(lambda c: named(c_custkey=c.c_custkey, balance=balance(c)))
    return held.select(lambda r: named(c_custkey=r.c_custkey, label=r.balance.match(debt=lambda d: lit("debt"), credit=lambda x: x.segment, even=lambda _: lit("even"))))


@query("SELECT c_custkey, CASE WHEN c_nationkey > 5 THEN c_acctbal > 0 END AS outer_, CASE WHEN c_nationkey > 5 AND c_acctbal > 0 THEN c_acctbal END AS inner_ FROM customer")
def option_nested(t):
    def nest(c):
        twice = when(c.c_nationkey > 5, when(c.c_acctbal > 0.0, c.c_acctbal))
        return named(c_custkey=c.c_custkey, outer_=twice.map(lambda x: ~x.is_empty()), inner_=twice.flat_map(lambda x: x))

    return t("customer").select(nest)


# --- explode, subqueries, functions -----------------------------------------------------------------------------------


@query("SELECT lang, w AS word, count(*) AS n FROM (SELECT lang, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY ALL HAVING count(*) > 50")
def explode_split_words(t):
    words = t("documents").select(lambda d: named(lang=d.lang, words=d.text.split(" "))).select(lambda r: r.lang, lambda r: explode(r.words))
    return words.group_by(lang=lambda r: r._1, word=lambda r: r._2).aggregate(n=lambda _: A.count()).where(lambda r: r.n > lit(50, LONG))


@query("SELECT n_nationkey AS _1, a AS _2, b AS _3 FROM nation, (SELECT unnest([1, 2, 3]) AS a), (SELECT unnest(['x', 'y']) AS b)")
def explode_cartesian(t):
    return t("nation").select(lambda n: n.n_nationkey, lambda n: explode(seq(1, 2, 3)), lambda n: explode(seq("x", "y")))


@query("SELECT c_custkey AS _1, c_acctbal AS _2 FROM customer WHERE c_acctbal > 7000")
def explode_option(t):
    return t("customer").select(lambda c: c.c_custkey, lambda c: explode(when(c.c_acctbal > 7000.0, c.c_acctbal)))


@query("SELECT n_nationkey AS _1, k AS a, v AS b FROM nation, LATERAL (SELECT unnest(['name', 'region']) AS k, unnest([n_name, n_regionkey::VARCHAR]) AS v)")
def explode_map(t):
    rows = t("nation").select(lambda n: n.n_nationkey, lambda n: explode(make_map(("name", n.n_name), ("region", n.n_regionkey.cast(STRING)))))
    return rows.select(lambda r: named(_1=r._1, a=r._2.opened()._1, b=r._2.opened()._2))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)")
def subquery_scalar_max(t):
    most = t("orders").aggregate(lambda o: A.max_(o.o_totalprice))
    return t("orders").where(lambda o: most.value.contains(o.o_totalprice)).select(lambda o: named(o_orderkey=o.o_orderkey, o_totalprice=o.o_totalprice))


@query("SELECT r_name, EXISTS (SELECT 1 FROM nation WHERE n_regionkey > 3) AS some, EXISTS (SELECT 1 FROM nation WHERE n_regionkey > 30) AS never FROM region WHERE EXISTS (SELECT 1 FROM nation)")
def subquery_exists(t):
    nation = t("nation")
    kept = t("region").where(lambda r: nation.exists())
    return kept.select(lambda r: named(r_name=r.r_name, some=nation.where(lambda n: n.n_regionkey > 3).exists(), never=nation.where(lambda n: n.n_regionkey > 30).exists()))


@query("SELECT r_regionkey, (SELECT count(*) FROM nation) AS nations, (SELECT count(*) FROM nation WHERE n_regionkey > 50) AS none FROM region")
def subquery_count(t):
    nation = t("nation")
    return t("region").select(lambda r: named(r_regionkey=r.r_regionkey, nations=nation.count().value, none=nation.where(lambda n: n.n_regionkey > 50).count().value))


@query("SELECT r_regionkey, (SELECT count(*) FROM nation)::INTEGER AS n FROM region")
def subquery_collect(t):
    nation = t("nation")
    return t("region").select(lambda r: named(r_regionkey=r.r_regionkey, n=nation.collect_rows().value.size()))


@query("SELECT event_id FROM events WHERE ts::DATE = (SELECT max(ts::DATE) FROM events WHERE ts::DATE <= (SELECT min(ts::DATE) + 3 FROM events))")
def latest_partition_sim(t):
    day = lambda e: sql_column(e.ts.col.cast("date"), DATE)
    events = t("events")
    first = events.aggregate(lambda e: A.min_(day(e)))
    until = events.where(lambda e: day(e).to_days() <= first.value.map(lambda d: d.to_days() + 3).expect("no events"))
    newest = until.aggregate(lambda e: A.max_(day(e)))
    return events.where(lambda e: newest.value.contains(day(e))).select(lambda e: named(event_id=e.event_id))


@query("SELECT p_partkey, p_size * 3 + 1 AS value FROM part")
def udf_scalar(t):
    return t("part").select(lambda p: named(p_partkey=p.p_partkey, value=p.p_size.udf(lambda x: x * 3 + 1, INT)))


@query("SELECT n_nationkey AS _1, reverse(n_name) AS _2 FROM nation WHERE n_regionkey <> 2")
def map_rows(t):
    return t("nation").filter(lambda n: n.n_regionkey != 2).map(lambda n: (n.n_nationkey, n.n_name[::-1]), tuple[Int, str])


@query("SELECT n_nationkey AS _1, c AS _2 FROM (SELECT n_nationkey, unnest(string_split(n_name, '')) AS c FROM nation) WHERE c <> ''")
def flat_map_rows(t):
    return t("nation").flat_map(lambda n: [(n.n_nationkey, c) for c in n.n_name], tuple[Int, str])


@query("SELECT sum(o_orderkey)::BIGINT AS total FROM orders")
def map_partitions(t):
    sums = t("orders").map_partitions(lambda rows: iter([sum(o.o_orderkey for o in rows)]), int)
    return sums.aggregate(lambda n: A.sum_(n)).select(lambda r: named(total=r.expect("no rows")))


@query("SELECT a.n_regionkey, a.n AS nations, b.n AS again FROM (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1) a JOIN (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1) b USING (n_regionkey)")
def cached_reuse(t):
    counted = t("nation").group_by(n_regionkey=lambda n: n.n_regionkey).aggregate(n=lambda _: A.count()).cache()
    return counted.join(counted, lambda a, b: a.n_regionkey == b.n_regionkey).select(lambda r: named(n_regionkey=r._1.n_regionkey, nations=r._1.n, again=r._2.n))


# --- files ------------------------------------------------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir. Only a local master may lack that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/catalogue-{uuid.uuid4().hex}"


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def write_read_parquet(t):
    nation = t("nation")
    path = _folder(nation.frame.sparkSession)
    io.write(nation, path)
    return io.read(nation.frame.sparkSession, path, TABLES["nation"])


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def write_read_json(t):
    nation = t("nation")
    path = _folder(nation.frame.sparkSession)
    io.write(nation, path, "json")
    return io.read(nation.frame.sparkSession, path, TABLES["nation"], "json")


@dataclass
class ByRegion:
    n_regionkey: Int


@dataclass
class NationOnly:
    n_nationkey: Int
    n_name: str


@query("SELECT n_regionkey, n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3)")
def hive_partitions(t):
    nation = t("nation")
    spark, path = nation.frame.sparkSession, _folder(nation.frame.sparkSession)
    io.write_hive(nation.select(lambda n: n.project(ByRegion), lambda n: n.project(NationOnly)), path)
    return io.read_hive(spark, path, ByRegion, NationOnly, n_regionkey=[1, 3]).select(lambda r: r._1.opened().merge(r._2.opened()))


@query("SELECT DISTINCT n_regionkey FROM nation")
def partition_values(t):
    nation = t("nation")
    spark, path = nation.frame.sparkSession, _folder(nation.frame.sparkSession)
    io.write_hive(nation.select(lambda n: n.project(ByRegion), lambda n: n.project(NationOnly)), path)
    return hive.read_partitions(spark, path, ByRegion)


@query("SELECT n_regionkey, n_nationkey, n_name FROM nation WHERE n_regionkey = 3")
def latest_partition(t):
    nation = t("nation")
    spark, path = nation.frame.sparkSession, _folder(nation.frame.sparkSession)
    io.write_hive(nation.select(lambda n: n.project(ByRegion), lambda n: n.project(NationOnly)), path)
    found = hive.read_latest(io.read_hive(spark, path, ByRegion, NationOnly), hive.read_partitions(spark, path, ByRegion), 3, "n_regionkey")
    return found.select(lambda r: r._1.opened().merge(r._2.opened()))


@dataclass
class ByTwo:
    n_regionkey: Int
    n_nationkey: Int


@dataclass
class NameOnly:
    n_name: str


def _by_two(t):
    nation = t("nation")
    spark, path = nation.frame.sparkSession, _folder(nation.frame.sparkSession)
    io.write_hive(nation.select(lambda n: n.project(ByTwo), lambda n: n.project(NameOnly)), path)
    return spark, path


@query("SELECT n_regionkey, n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3) AND n_nationkey IN (2, 3, 6, 7)")
def hive_two_fields(t):
    spark, path = _by_two(t)
    return io.read_hive(spark, path, ByTwo, NameOnly, n_regionkey=[1, 3], n_nationkey=[2, 3, 6, 7]).select(lambda r: r._1.opened().merge(r._2.opened()))


@query("SELECT n_regionkey, n_nationkey, n_name FROM nation WHERE n_nationkey = (SELECT max(n_nationkey) FROM nation WHERE n_nationkey <= 20)")
def latest_of_two_fields(t):
    spark, path = _by_two(t)
    found = hive.read_latest(io.read_hive(spark, path, ByTwo, NameOnly), hive.read_partitions(spark, path, ByTwo), 20, "n_nationkey")
    return found.select(lambda r: r._1.opened().merge(r._2.opened()))


@query("SELECT n_regionkey, n_nationkey, n_name FROM nation JOIN (SELECT n_regionkey AS k, max(n_nationkey) AS m FROM nation WHERE n_nationkey <= 20 GROUP BY 1) ON n_regionkey = k AND n_nationkey = m")
def latest_per_key(t):
    spark, path = _by_two(t)
    found = hive.read_latest_per_partition(io.read_hive(spark, path, ByTwo, NameOnly), hive.read_partitions(spark, path, ByTwo), 20, "n_nationkey")
    return found.select(lambda r: r._1.opened().merge(r._2.opened()))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def read_glob(t):
    nation = t("nation")
    path = _folder(nation.frame.sparkSession)
    io.write(nation, path)
    return io.read(nation.frame.sparkSession, path, TABLES["nation"], glob="part-*")


@query("SELECT n_name, TRUE AS ends FROM nation")
def read_with_metadata(t):
    nation = t("nation")
    path = _folder(nation.frame.sparkSession)
    io.write(nation, path)
    rows = io.read(nation.frame.sparkSession, path, TABLES["nation"], metadata=True)
    return rows.select(lambda r: named(n_name=r._2.opened().n_name, ends=r._1.opened().file_path.ends_with(".parquet")))


@query("SELECT n_regionkey, n_nationkey, n_name FROM nation")
def read_table_rows(t):
    nation = t("nation")
    spark, name = nation.frame.sparkSession, f"catalogue_{uuid.uuid4().hex}"
    nation.to_df().select("n_nationkey", "n_name", "n_regionkey").write.partitionBy("n_regionkey").saveAsTable(name)
    return io.read_table(spark, name, NationOnly, ByRegion).select(lambda r: r._1.opened().merge(r._2.opened()))


@query("SELECT DISTINCT n_regionkey FROM nation")
def table_partition_values(t):
    nation = t("nation")
    spark, name = nation.frame.sparkSession, f"catalogue_{uuid.uuid4().hex}"
    nation.to_df().write.partitionBy("n_regionkey").saveAsTable(name)
    return hive.read_table_partitions(spark, name, ByRegion)


@query("SELECT n_regionkey FROM nation WHERE FALSE")
def empty_rows(t):
    return Dataset.empty(t("nation").frame.sparkSession, ByRegion)


@query("SELECT 42 AS n_regionkey")
def single_row(t):
    return Dataset.single(t("nation").frame.sparkSession, ByRegion, ByRegion(42))


@query("SELECT n_nationkey, n_name FROM nation")
def values_only(t):
    return t("nation").select(lambda n: n.project(ByRegion), lambda n: n.project(NationOnly)).values()


@query("SELECT n_regionkey, max(n_name) AS value FROM nation GROUP BY 1")
def agg_value(t):
    return t("nation").group_by(n_regionkey=lambda n: n.n_regionkey).aggregate_value(lambda n: A.max_(n.n_name))


@query("SELECT s_suppkey, n_name FROM (SELECT * FROM supplier WHERE s_nationkey < 12) RIGHT JOIN nation ON s_nationkey = n_nationkey")
def join_right_flat(t):
    some_ = t("supplier").where(lambda s: s.s_nationkey < 12)
    return some_.right_join_flat(t("nation"), lambda s, n: s.s_nationkey == n.n_nationkey).select(lambda r: named(s_suppkey=r.s_suppkey, n_name=r.n_name))


@query("SELECT s_suppkey, n_name FROM (SELECT * FROM supplier WHERE s_nationkey < 12) FULL JOIN (SELECT * FROM nation WHERE n_nationkey > 5) ON s_nationkey = n_nationkey")
def join_full_flat(t):
    left, right = t("supplier").where(lambda s: s.s_nationkey < 12), t("nation").where(lambda n: n.n_nationkey > 5)
    return left.full_join_flat(right, lambda s, n: s.s_nationkey == n.n_nationkey).select(lambda r: named(s_suppkey=r.s_suppkey, n_name=r.n_name))


@query("SELECT n_name, a, b FROM (SELECT n_name, n_nationkey AS a, r_regionkey AS b FROM nation FULL JOIN (SELECT * FROM region WHERE r_regionkey > 1) ON n_regionkey < r_regionkey)")
def join_full_theta(t):
    right = t("region").where(lambda r: r.r_regionkey > 1)
    joined = t("nation").full_join(right, lambda n, r: n.n_regionkey < r.r_regionkey)
    return joined.select(lambda x: named(n_name=x._1.map(lambda n: n.n_name), a=x._1.map(lambda n: n.n_nationkey), b=x._2.map(lambda r: r.r_regionkey)))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey < 3")
def checkpoint_rows(t):
    nation = t("nation").where(lambda n: n.n_regionkey < 3)
    return io.checkpoint(nation, _folder(nation.frame.sparkSession))

