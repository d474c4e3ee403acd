"""Hive-style partitions: paths, escaping, values from directory names, the newest date."""

from __future__ import annotations

import datetime
import re
import urllib.parse
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quern.functions.expr import E
from quern.operators.dataset import Dataset, Single
from quern.types import DATE, INT, STRING, Enum, Kind, Product, TypeProblem, encode, kind_of, require

_ESCAPED = set('"#%\'*/:=?\\{[]^\x7f') | {chr(c) for c in range(1, 32)}
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def escape(value: str) -> str:
    """As Spark escapes partition values."""
    return "".join(f"%{ord(c):02X}" if c in _ESCAPED else c for c in value)


def partition_kind(model: Any) -> Product:
    """A product of ints, strings, dates and enums."""
    kind = kind_of(model)
    require(isinstance(kind, Product) and bool(kind.fields) and all(k in (INT, STRING, DATE) or isinstance(k, Enum) for _, k in kind.fields), f"{kind} can't be in a path")
    return kind


def text_of(kind: Kind, value: Any) -> str:
    value = encode(kind, value)
    text = value.isoformat() if kind == DATE else str(value)
    require(text != "", "an empty string can't be a partition value")
    return text


def value_of(kind: Kind, text: str) -> Any:
    if kind == INT:
        require(bool(re.fullmatch(r"[+-]?[0-9]+", text)), f"{text!r} is no int")
        return int(text)
    if kind == DATE:
        return datetime.date.fromisoformat(text)
    if isinstance(kind, Enum):
        require(text in kind.values, f"{text!r} is not in {kind}")
    return text


@dataclass(frozen=True)
class NoPartitions:
    """A plain folder."""

    def path(self, base: str, **_: Any) -> str:
        return base.rstrip("/") + "/"


@dataclass(frozen=True)
class Hive:
    """Folders name=value in the order of the model's fields."""

    model: Any

    @property
    def kind(self) -> Product:
        return partition_kind(self.model)

    def path(self, base: str, **values: Any) -> str:
        """For each field no value (*), one, or several ({a,b})."""
        parts = []
        for n, k in self.kind.fields:
            given = values.get(n, [])
            texts = [escape(text_of(k, v)) for v in (given if isinstance(given, (list, tuple, set)) else [given])]
            parts.append(f"{n}=" + ("*" if not texts else texts[0] if len(texts) == 1 else "{" + ",".join(texts) + "}"))
        return f"{base.rstrip('/')}/" + "/".join(parts) + ("/" if all("*" not in p and "{" not in p for p in parts) else "")

    def predicate(self, row: E, **values: Any) -> E | None:
        """The same restriction as a condition on partition values, which prunes folders."""
        out = None
        for n, given in values.items():
            many = given if isinstance(given, (list, tuple, set)) else [given]
            if many:
                one = E(kind_of(bool), row[n].col.isin(*(encode(self.kind.get(n), v) for v in many)))
                out = one if out is None else out & one
        return out

    def parse(self, path: str) -> dict[str, Any]:
        """Partition values of a path."""
        found = dict(p.split("=", 1) for p in path.split("/") if "=" in p)
        out = {}
        for n, k in self.kind.fields:
            require(n in found, f"no {n}= in {path}")
            require(found[n] != NO_VALUE, f"null for {n} in {path}")
            out[n] = value_of(k, urllib.parse.unquote(found[n]))
        return out


def list_folders(spark: SparkSession, pattern: str) -> list[str]:
    """Folders that a pattern matches, from the file system's own listing."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(conf).globStatus(path)
    return sorted(s.getPath().toString() for s in (found or []) if s.isDirectory())


def read_partitions(spark: SparkSession, base: str, model: Any, **values: Any) -> Dataset:
    """Distinct partition values by folder names, also of folders whose files hold no rows."""
    hive = Hive(model)
    rows = {tuple(hive.parse(f).items()) for f in list_folders(spark, hive.path(base, **values).rstrip("/"))}
    return Dataset.of_rows(spark, hive.kind, [dict(r) for r in sorted(rows, key=str)])


def read_table_partitions(spark: SparkSession, table: str, model: Any) -> Dataset:
    """Partition values of a catalogue table."""
    hive = Hive(model)
    quoted = ".".join(f"`{p}`" for p in table.split("."))
    return Dataset.of_rows(spark, hive.kind, [hive.parse(r[0]) for r in spark.sql(f"SHOW PARTITIONS {quoted}").collect()])


def latest(partitions: Dataset, run_date: Any, date: str = "date", override: Any = None) -> Single:
    """The newest partition date up to a run date (or the override), as a one-row dataset; an error if there is none."""
    kind = partitions.kind.get(date)
    if override is not None:
        return Single(*_pair(partitions, lambda c: F.lit(encode(kind, override)), date))
    newest = lambda c: F.max(F.when(c <= F.lit(encode(kind, run_date)), c))
    return Single(*_pair(partitions, lambda c: F.coalesce(newest(c), F.raise_error(F.lit("No partitions found")).cast("date" if kind == DATE else "int" if kind == INT else "string")), date))


def _pair(ds: Dataset, f: Callable, date: str) -> tuple:
    frame = ds.to_df().agg(f(F.col(f"`{date}`")).alias("newest"), F.count(F.lit(1)).alias("_n")).select("newest")
    return frame, E(ds.kind.get(date), F.col("newest"))


def read_latest(rows: Dataset, partitions: Dataset, run_date: Any, date: str = "date", override: Any = None) -> Dataset:
    """(P, T) rows of the newest date: the date is a lazy scalar subquery, which prunes folders when the query runs."""
    newest = latest(partitions, run_date, date, override)
    return rows.where(lambda r: r._1.opened()[date] == newest.value)


def read_latest_per_partition(rows: Dataset, partitions: Dataset, run_date: Any, date: str = "date") -> Dataset:
    """(P, T) rows of the newest date of each combination of the other partition fields; an error if no date is old enough."""
    others = [n for n in partitions.kind.names if n != date]
    require(bool(others), "needs partition fields besides the date")
    kind = partitions.kind.get(date)
    from quern.functions import aggregates

    known = partitions.where(lambda p: E(kind_of(bool), p[date].col <= F.lit(encode(kind, run_date))))
    newest = known.group_by(**{n: (lambda p, n=n: p[n]) for n in others}).aggregate(newest=lambda p: aggregates.max_(p[date]))

    def same(r: E, p: E) -> E:
        test = r._1.opened()[date] == p.newest
        for n in others:
            test = test & (r._1.opened()[n] == p[n])
        return test

    last = latest(partitions, run_date, date)
    return rows.where(lambda r: r._1.opened()[date] <= last.value).join(newest, same).select(lambda r: r._1)


__all__ = ["Hive", "NoPartitions", "TypeProblem", "escape", "latest", "read_latest", "read_latest_per_partition", "read_partitions", "read_table_partitions"]
