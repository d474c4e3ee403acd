"""Reading and writing files and tables of declared models: Parquet and JSON."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import json as wire
from quern.functions.expr import E, kind_from_spark, row_of, tuple_
from quern.operators.dataset import Dataset, placed
from quern.sources.partitions import Hive
from quern.types import BYTE, DOUBLE, FLOAT, INT, LONG, SHORT, STRING, Dec, Kind, Opt, Product, cast_type, is_opt, kind_of, nullable, require, schema

FORMATS = ("parquet", "json")
#: The narrower numbers as the wide ones that some stores keep them as.
_WIDE = {BYTE: LONG, SHORT: LONG, INT: LONG, FLOAT: DOUBLE}


def _fields(kind: Kind) -> tuple[tuple[str, Kind], ...]:
    return kind.fields if isinstance(kind, Product) else (("value", kind),)


def _required(col: Column, whole: Column, what: str, type_: T.DataType) -> Column:
    return F.when(whole, col).otherwise(F.raise_error(F.lit(f"{what} is missing or malformed")).cast(type_))


def _wide(kind: Kind) -> Kind:
    if isinstance(kind, Opt):
        return Opt(_wide(kind.of))
    return Dec(38, 9) if isinstance(kind, Dec) else _WIDE.get(kind, kind)


def _load(spark: SparkSession, path: str | list[str], kind: Kind, format: str, glob: str | None, partitions: Product | None, base: str | None, widen: bool) -> tuple[DataFrame, dict[str, E]]:
    require(format in FORMATS, f"{format} is none of {FORMATS}")
    json = format == "json"
    own = [T.StructField(n, wire.wire_type(k) if json else nullable(cast_type(_wide(k) if widen else k)), True) for n, k in _fields(kind)]
    more = [T.StructField(n, cast_type(k), True) for n, k in (partitions.fields if partitions else ())]
    reader = spark.read.schema(T.StructType(own + more)).format(format)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if base:
        reader = reader.option("basePath", base)
    if json:
        reader = reader.options(mode="FAILFAST", **wire.OPTIONS)
    df = reader.load(path)
    parts = {}
    for n, k in _fields(kind):
        col = F.col(f"`{n}`")
        if json:
            col = _required(wire.inward(k, col), wire.sound(k, col), n, cast_type(k))
        elif widen and _wide(k) != k:
            narrow = col.try_cast(cast_type(k))
            col = _required(narrow, col.isNull() | narrow.isNotNull(), n, cast_type(k))
        parts[n] = E(k, col)
    return df, parts


def _row(kind: Kind, parts: dict[str, E]) -> E:
    return E(kind, None, parts) if isinstance(kind, Product) else parts["value"]


def read(spark: SparkSession, path: str, model: Any, format: str = "parquet", glob: str | None = None, widen: bool = False, metadata: bool = False) -> Dataset:
    """Rows of files with the declared schema. `metadata` gives (file path, row); `widen` reads numbers in their wide form and narrows them, with an error where one doesn't fit."""
    kind = kind_of(model)
    df, parts = _load(spark, path, kind, format, glob, None, None, widen)
    row = _row(kind, parts)
    return placed(df, tuple_(row_of([("file_path", STRING, F.col("_metadata.file_path"))]), row) if metadata else row)


def read_hive(spark: SparkSession, base: str, partitions: Any, model: Any, format: str = "parquet", glob: str | None = None, widen: bool = False, metadata: bool = False, **values: Any) -> Dataset:
    """(P, T) rows below base, only of the folders that the partition values allow; with `metadata` (file path, P, T)."""
    hive, kind = Hive(partitions), kind_of(model)
    df, parts = _load(spark, base, kind, format, glob, hive.kind, base, widen)
    own = row_of([(n, k, F.col(f"`{n}`")) for n, k in hive.kind.fields], hive.kind.cls)
    test = hive.predicate(own, **values)
    df = df if test is None else df.where(test.col)
    row = _row(kind, parts)
    return placed(df, tuple_(row_of([("file_path", STRING, F.col("_metadata.file_path"))]), own, row) if metadata else tuple_(own, row))


def read_table(spark: SparkSession, table: str, model: Any, partitions: Any = None, check: str = "strict") -> Dataset:
    """Rows of a catalogue table, (P, T) if partitions are named. `check` is strict, warn or off."""
    from quern.plans.validate import check_schema

    kind = kind_of(model)
    df = spark.read.table(table)
    check_schema(df.schema, kind, check)
    row = _row(kind, {n: E(k, df[f"`{n}`"]) for n, k in _fields(kind)})
    if partitions is None:
        return placed(df, row)
    own = Hive(partitions).kind
    return placed(df, tuple_(row_of([(n, k, df[f"`{n}`"]) for n, k in own.fields], own.cls), row))


def can_widen(source: T.DataType, to: Kind) -> bool:
    """Whether unpivot may turn a column into the value column's kind without loss."""
    from quern.functions.expr import can_cast

    return can_cast(kind_from_spark(source), to) and not isinstance(source, T.StringType) or cast_type(to) == source


def read_unpivoted(spark: SparkSession, path: str, model: Any, format: str = "parquet", metadata: bool = False) -> Dataset:
    """Files whose columns beyond the model's first ones are turned into rows: the model's last two fields take a column's
    name and its value. Values may only be widened, and a nullable column can't become a required value."""
    kind = kind_of(model)
    require(isinstance(kind, Product) and len(kind.fields) >= 2, "unpivot needs a product of at least two fields")
    *ids, (name, name_kind), (value, value_kind) = kind.fields
    require(name_kind == STRING, f"the name column {name!r} is no string")
    df = spark.read.format(format).load(path)
    if not metadata:
        return unpivot(df, kind)
    own = "_file_path"
    long = unpivot(df.select("*", F.col("_metadata.file_path").alias(own)), Product(((own, STRING), *kind.fields)))
    return long.select(lambda r: tuple_(row_of([("file_path", STRING, r[own].col)]), row_of([(n, k, r[n].col) for n, k in kind.fields], kind.cls)))


def unpivot(df: DataFrame, model: Any) -> Dataset:
    """Columns beyond the model's first ones as rows: the last two fields take a column's name and its value."""
    kind = kind_of(model)
    *ids, (name, _), (value, value_kind) = kind.fields
    kept = [n for n, _ in ids]
    rest = [f for f in df.schema if f.name not in kept]
    target = value_kind.of if is_opt(value_kind) else value_kind
    for f in rest:
        require(can_widen(f.dataType, target), f"column {f.name!r} of {f.dataType.simpleString()} can't become {target}")
    cast = df.select(*(F.col(f"`{n}`") for n in kept), *(F.col(f"`{f.name}`").cast(cast_type(target)).alias(f.name) for f in rest))
    long = cast.unpivot([F.col(f"`{n}`") for n in kept], [F.col(f"`{f.name}`") for f in rest], name, value)
    if not is_opt(value_kind):
        long = long.withColumn(value, _required(F.col(value), F.col(value).isNotNull(), value, cast_type(target)))
    return Dataset.of_df(long, kind)


def write(ds: Dataset, path: str, format: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Write rows; an existing target is an error. JSON gets the wire form."""
    require(format in FORMATS, f"{format} is none of {FORMATS}")
    df = ds.to_df()
    if format == "json":
        df = df.select(*(wire.outward(k, F.col(f"`{n}`")).alias(n) for n, k in _fields(ds.kind)))
    writer = df.write.format(format).mode("errorifexists")
    if format == "json":
        writer = writer.options(ignoreNullFields="true", **wire.WRITE_OPTIONS)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path.rstrip("/") + "/")


def write_hive(ds: Dataset, path: str, format: str = "parquet") -> None:
    """Write (P, T) rows into folders by P; empty strings are refused."""
    own = ds.kind.fields[0][1]

    def flat(r: E) -> E:
        p = r._1.opened()
        parts = {n: E(k, F.when(p[n].col == "", F.raise_error(F.lit(f"an empty string can't be a partition value ({n})")).cast("string")).otherwise(p[n].col)) if k == STRING else p[n] for n, k in own.fields}
        return row_of([(n, k, parts[n].col) for n, k in own.fields]).merge(r._2.opened())

    write(ds.select(flat), path, format, own.names)


def checkpoint(ds: Dataset, base: str) -> Dataset:
    """Write the rows below base and read them again: cuts the lineage."""
    import uuid

    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}/"
    write(ds, path)
    return read(ds.frame.sparkSession, path, ds.kind)


__all__ = ["FORMATS", "checkpoint", "read", "read_hive", "read_table", "read_unpivoted", "schema", "unpivot", "write", "write_hive"]
