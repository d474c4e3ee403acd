import datetime
import decimal
from dataclasses import dataclass

import pytest

from quern import cli
from quern.functions import aggregates as A
from quern.functions.expr import E
from quern.job import Job, run_job_for_test, sinks, sources
from quern.operators import Dataset
from quern.plans.ddl import to_ddl, to_json_schema
from quern.plans.validate import check_schema
from quern.sources import Hive, checkpoint, io, latest, read, read_hive, read_latest_per_partition, read_partitions, read_table, read_table_partitions, write, write_hive
from quern.sources.job_io import PathSink, PathSource, PathTable, TableSource, TestSink, TestSource
from quern.streaming import read_stream, write_stream
from quern.types import BINARY, INT, LONG, STRING, Decimal, Double, Int, Long, TypeProblem, kind_of, product, schema


@dataclass
class Everything:
    a: bool
    b: Int
    c: Long
    d: Double
    e: str
    f: bytes
    g: Decimal(38, 9)
    h: datetime.date
    i: datetime.timedelta
    j: Long | None
    k: list[Long]
    l: dict[str, Long]
    m: list[list[str]]


ROWS = [
    Everything(True, 1, 2**60, 0.5, "é\n", b"\x00\x01", decimal.Decimal("1.500000000"), datetime.date(2000, 2, 29), datetime.timedelta(microseconds=7), None, [1], {"x": 1}, [["a"], []]),
    Everything(False, -1, -(2**60), -1e300, "", b"", decimal.Decimal("-2.000000000"), datetime.date(1, 1, 1), datetime.timedelta(days=-3), 5, [], {}, []),
]


@pytest.mark.parametrize("format", ["parquet", "json"])
def test_round_trip(spark, tmp_path, format):
    path = str(tmp_path / "t")
    write(Dataset.of_rows(spark, Everything, ROWS), path, format)
    assert sorted(read(spark, path, Everything, format).collect(), key=repr) == sorted(ROWS, key=repr)
    with pytest.raises(Exception, match="(?i)exist"):
        write(Dataset.of_rows(spark, Everything, ROWS), path, format)
    path_and_row = read(spark, path, Everything, format, metadata=True).collect()
    assert all(x[0]["file_path"].startswith("file:") for x in path_and_row)


def test_json_numbers_as_text(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"n": "12"}\n{"n": 7}\n')
    assert sorted(r["n"] for r in read(spark, str(tmp_path), product(n=INT), "json").collect()) == [7, 12]
    (tmp_path / "y.json").write_text('{"n": 2147483648}\n')
    with pytest.raises(Exception, match="malformed"):
        read(spark, str(tmp_path), product(n=INT), "json").collect()


def test_widened_numbers(spark, tmp_path):
    spark.createDataFrame([(1, 2.0)], "a long, b double").write.parquet(str(tmp_path / "w"))
    assert read(spark, str(tmp_path / "w"), product(a=INT), widen=True).collect() == [{"a": 1}]


@dataclass(frozen=True)
class P:
    p: Int
    q: str


@dataclass(frozen=True)
class M:
    m: Long


def test_hive_partitions(spark, tmp_path):
    base = str(tmp_path / "h")
    rows = [(P(1, "a/b"), M(1)), (P(1, "c=d%"), M(2)), (P(2, "a/b"), M(3))]
    write_hive(Dataset.of_rows(spark, tuple[P, M], rows), base)
    assert (tmp_path / "h/p=1/q=a%2Fb").is_dir()
    assert sorted(read_hive(spark, base, P, M).collect(), key=repr) == sorted(rows, key=repr)
    some = read_hive(spark, base, P, M, p=1, q=["a/b", "x"])
    assert some.collect() == rows[:1] and "PartitionFilters: [" in some.explain("formatted")
    assert sorted(read_partitions(spark, base, P).collect(), key=repr) == sorted((r[0] for r in rows), key=repr)
    assert read_partitions(spark, base, P, p=2).collect() == [P(2, "a/b")]
    assert Hive(P).path("/b", p=[1, 2]) == "/b/p={1,2}/q=*" and Hive(P).path("/b", p=1, q="a/b") == "/b/p=1/q=a%2Fb/"
    with pytest.raises(TypeProblem):
        Hive(product(x=BINARY)).kind
    with pytest.raises(Exception, match="empty string"):
        write_hive(Dataset.of_rows(spark, tuple[P, M], [(P(1, ""), M(1))]), str(tmp_path / "bad"))


@dataclass(frozen=True)
class D:
    date: Int
    other: str


def test_latest(spark):
    parts = Dataset.of_rows(spark, D, [D(1, "x"), D(2, "x"), D(2, "y"), D(3, "x")])
    assert latest(parts, 2).collect_value() == 2
    assert latest(parts, 10).collect_value() == 3
    assert latest(parts, 10, override=1).collect_value() == 1
    with pytest.raises(Exception, match="No partitions found"):
        latest(parts, 0).collect_value()
    rows = Dataset.of_rows(spark, tuple[D, M], [(D(1, "x"), M(1)), (D(2, "x"), M(2)), (D(2, "y"), M(3)), (D(3, "x"), M(4))])
    assert sorted(r[1].m for r in read_latest_per_partition(rows, parts, 2).collect()) == [2, 3]
    assert sorted(r[1].m for r in read_latest_per_partition(rows, parts, 9).collect()) == [3, 4]


@dataclass(frozen=True)
class Two:
    region: Int
    day: Int


def test_latest_goes_by_the_named_field(spark):
    parts = Dataset.of_rows(spark, Two, [Two(9, 1), Two(2, 5), Two(1, 7)])
    assert latest(parts, 100, "day").collect_value() == 7 and latest(parts, 100, "region").collect_value() == 9
    assert latest(parts, 6, "day").collect_value() == 5
    rows = Dataset.of_rows(spark, tuple[Two, M], [(Two(9, 1), M(1)), (Two(2, 5), M(2)), (Two(1, 7), M(3))])
    assert [r[1].m for r in read_latest_per_partition(rows, parts, 4, "day").collect()] == [1]
    with pytest.raises(Exception, match="No partitions found"):
        read_latest_per_partition(rows, parts, 0, "day").collect()


def test_tables(spark):
    spark.sql("DROP TABLE IF EXISTS parted")
    spark.createDataFrame([(1, 1, "a"), (2, 2, "b")], "m long, p int, q string").write.partitionBy("p", "q").saveAsTable("parted")
    assert sorted(read_table(spark, "parted", M, P).collect(), key=repr) == [(P(1, "a"), M(1)), (P(2, "b"), M(2))]
    assert sorted(read_table_partitions(spark, "parted", P).collect(), key=repr) == [P(1, "a"), P(2, "b")]
    with pytest.raises(TypeProblem, match="missing"):
        read_table(spark, "parted", product(z=LONG))
    with pytest.warns(UserWarning):
        check_schema(schema(product(a=STRING)), kind_of(product(a=LONG)), "warn")
    assert TableSource("parted").dataset(spark, M, P, p=2).values().collect() == [M(2)]


def test_unpivot(spark):
    df = spark.createDataFrame([(1, "x", "y")], "a int, b string, c string").select("a", "b", "c")
    kind = product(a=INT, column=STRING, value=STRING)
    assert sorted(r["column"] + r["value"] for r in io.unpivot(df, kind).collect()) == ["bx", "cy"]
    numbers = spark.sql("select 1 a, 2 b, 3L c")
    assert sorted(r["value"] for r in io.unpivot(numbers, product(a=INT, column=STRING, value=LONG)).collect()) == [2, 3]
    with pytest.raises(TypeProblem):
        io.unpivot(df, product(a=INT, column=STRING, value=LONG))
    with pytest.raises(Exception, match="missing"):
        io.unpivot(spark.sql("select 1 a, cast(null as string) b"), kind).collect()


def test_unpivoted_files(spark, tmp_path):
    spark.sql("select 1 a, 'x' b, 'y' c").write.parquet(str(tmp_path / "wide"))
    kind = product(a=INT, column=STRING, value=STRING)
    assert PathSource(str(tmp_path / "wide"), unpivot=True).dataset(spark, kind).values().count().collect_value() == 2
    (one, _) = sorted(PathSource(str(tmp_path / "wide"), unpivot=True).dataset(spark, kind).with_file_metadata().collect(), key=repr)
    assert one[0]["file_path"].endswith(".parquet") and one[1] == {"a": 1, "column": "b", "value": "x"}


def test_checkpoint_and_streams(spark, tmp_path):
    ds = Dataset.of_rows(spark, M, [M(1), M(2)])
    assert sorted(m.m for m in checkpoint(ds, str(tmp_path / "c")).collect()) == [1, 2]
    write(ds, str(tmp_path / "in"))
    stream = read_stream(spark, str(tmp_path / "in"), M).where(lambda r: r.m > E(LONG, __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))).select(lambda r: r.copy(m=r.m + r.m))
    write_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert read(spark, str(tmp_path / "out"), M).collect() == [M(4)]


@dataclass
class CountArgs:
    users: PathSource | TestSource
    counts: PathSink | TestSink
    least: int = 1


class CountJob(Job):
    Args = CountArgs

    def run(self, context, args):
        users = context.read(args.users, M).values()
        counted = users.where(lambda u: u.m > E(LONG, __import__("pyspark.sql.functions", fromlist=["lit"]).lit(args.least))).group_by(m=lambda u: u.m).aggregate(n=lambda _: A.count())
        context.write(context.checkpoint(counted, None), args.counts)


class SilentJob(CountJob):
    def run(self, context, args):
        pass


def test_jobs(spark, tmp_path):
    args = CountArgs(TestSource([M(1), M(2), M(2)]), TestSink())
    assert run_job_for_test(CountJob(), args, spark) == {"counts": [{"m": 2, "n": 2}]}
    with pytest.raises(AssertionError, match="counts"):
        run_job_for_test(SilentJob(), CountArgs(TestSource([]), TestSink()), spark)
    assert [n for n, _ in sources(args)] == ["users"] and [n for n, _ in sinks(args)] == ["counts"]
    write(Dataset.of_rows(spark, M, [M(5)]), str(tmp_path / "u"))
    argv = ["--users", "path-source", "--users-path", str(tmp_path / "u"), "--counts", "path-sink", "--counts-path", str(tmp_path / "n")]
    parsed = cli.parse(CountArgs, argv)
    CountJob().execute(spark, parsed)
    assert read(spark, str(tmp_path / "n"), product(m=LONG, n=LONG)).collect() == [{"m": 5, "n": 1}]
    assert cli.parse(CountArgs, cli.unparse(parsed)) == parsed
    assert PathTable("u", M).read(spark, str(tmp_path)).values().collect() == [M(5)]


@dataclass
class Inner:
    some_path: str = "x"


@dataclass
class Args:
    run_date: datetime.date
    inner: Inner
    numbers: list[int]
    verbose: bool = False
    limit: int | None = None


def test_command_lines():
    got = cli.parse(Args, ["--run-date", "2024-01-02", "--numbers", "1", "2", "--inner-some-path=y", "--verbose"])
    assert got == Args(datetime.date(2024, 1, 2), Inner("y"), [1, 2], True, None)
    assert cli.parse(Args, cli.unparse(got)) == got
    with pytest.raises(cli.ArgsError) as wrong:
        cli.parse(Args, ["--limit", "x", "--what", "1"])
    assert len(wrong.value.problems) == 3
    with pytest.raises(cli.HelpWanted, match="--inner-some-path"):
        cli.parse(Args, ["--help"])
    assert CountJob.main(["--help"]) == 0 and CountJob.main([]) == 2


def test_definitions():
    assert to_ddl(product(a=INT, b=list[str])) == "a INT NOT NULL, b ARRAY<STRING> NOT NULL"
    assert to_ddl(P, pretty=True) == "  p INT NOT NULL,\n  q STRING NOT NULL"
    assert to_json_schema(P)["required"] == ["p", "q"]
    assert to_json_schema(P)["properties"]["p"] == {"type": "integer", "minimum": -(2**31), "maximum": 2**31 - 1}
