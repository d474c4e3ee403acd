"""Sources and sinks of jobs: paths, tables, or test doubles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

from quern.operators.dataset import Dataset
from quern.sources import io, partitions
from quern.types import require


@dataclass(frozen=True)
class PathSource:
    """Files below a path."""

    path: str
    format: str = "parquet"
    glob: str | None = None
    unpivot: bool = False
    widen: bool = False

    def dataset(self, spark: SparkSession, model: Any, partitioner: Any = None, **values: Any) -> ReadDataset:
        if self.unpivot:
            return ReadDataset(lambda meta: io.read_unpivoted(spark, self.path, model, self.format, meta))
        if partitioner is None:
            return ReadDataset(lambda meta: io.read(spark, self.path, model, self.format, self.glob, self.widen, meta))
        return ReadDataset(lambda meta: io.read_hive(spark, self.path, partitioner, model, self.format, self.glob, self.widen, meta, **values), True)

    def partitions(self, spark: SparkSession, partitioner: Any) -> Dataset:
        return partitions.read_partitions(spark, self.path, partitioner)


@dataclass(frozen=True)
class TableSource:
    """A catalogue table."""

    table: str
    check: str = "strict"

    def dataset(self, spark: SparkSession, model: Any, partitioner: Any = None, **values: Any) -> ReadDataset:
        def load(meta: bool) -> Dataset:
            require(not meta, "tables have no file metadata")
            ds = io.read_table(spark, self.table, model, partitioner, self.check)
            test = partitions.Hive(partitioner).predicate(ds.row._1.opened(), **values) if partitioner is not None else None
            return ds if test is None else ds.where(test)

        return ReadDataset(load, partitioner is not None)

    def partitions(self, spark: SparkSession, partitioner: Any) -> Dataset:
        return partitions.read_table_partitions(spark, self.table, partitioner)


@dataclass(frozen=True)
class TestSource:
    """Rows given by a test; (P, T) rows where partitions are asked for."""

    __test__ = False
    rows: list = field(default_factory=list)

    def dataset(self, spark: SparkSession, model: Any, partitioner: Any = None, **values: Any) -> ReadDataset:
        from quern.types import kind_of, tuple_of

        kind = kind_of(model) if partitioner is None else tuple_of(kind_of(partitioner), kind_of(model))
        return ReadDataset(lambda meta: Dataset.of_rows(spark, kind, self.rows), partitioner is not None)

    def partitions(self, spark: SparkSession, partitioner: Any) -> Dataset:
        return Dataset.of_rows(spark, partitioner, list(dict.fromkeys(r[0] for r in self.rows)))


@dataclass(frozen=True)
class ReadDataset:
    """A read whose form is chosen last, so file metadata is only read where it is wanted."""

    load: Callable[[bool], Dataset]
    partitioned: bool = False

    def values(self) -> Dataset:
        return self.load(False).values() if self.partitioned else self.load(False)

    def with_partition_values(self) -> Dataset:
        require(self.partitioned, "this source has no partitions")
        return self.load(False)

    def with_file_metadata(self) -> Dataset:
        """(file path, T)."""
        ds = self.load(True)
        return ds.select(lambda r: r._1, lambda r: r._3) if self.partitioned else ds

    def with_both(self) -> Dataset:
        """(file path, P, T)."""
        require(self.partitioned, "this source has no partitions")
        return self.load(True)


@dataclass(frozen=True)
class PathSink:
    path: str
    format: str = "parquet"

    def write(self, ds: Dataset, partitioned: bool = False) -> None:
        (io.write_hive if partitioned else io.write)(ds, self.path, self.format)


@dataclass
class TestSink:
    """Collects what a job writes; `verify` may look at the rows."""

    __test__ = False
    verify: Callable[[list], None] | None = None
    rows: list | None = None

    def write(self, ds: Dataset, partitioned: bool = False) -> None:
        self.rows = ds.collect()
        if self.verify:
            self.verify(self.rows)

    def by_partition(self) -> dict:
        out: dict = {}
        for p, v in self.rows or []:
            out.setdefault(p, []).append(v)
        return out


@dataclass(frozen=True)
class PathTable:
    """A table that is a folder: its model, partitions, format and the prefix it lives below."""

    name: str
    model: Any
    partitioner: Any = None
    format: str = "parquet"

    def source(self, prefix: str) -> PathSource:
        return PathSource(f"{prefix.rstrip('/')}/{self.name}/", self.format)

    def sink(self, prefix: str) -> PathSink:
        return PathSink(f"{prefix.rstrip('/')}/{self.name}/", self.format)

    def read(self, spark: SparkSession, prefix: str, **values: Any) -> ReadDataset:
        return self.source(prefix).dataset(spark, self.model, self.partitioner, **values)
