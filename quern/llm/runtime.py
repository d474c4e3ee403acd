"""What the operators share: the shared scratch folder, Arrow batches cut by bytes."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quern.session import ship

#: Text bytes handled at once in a Python worker; bounds its memory whatever the Arrow batch size.
SLICE_BYTES = 8 << 20


_written: list[str] = []


def clear_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables that this driver has written; results that still depend on them can't be read after."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def scratch(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir. Only a local master may lack that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    _written.append(f"{base.rstrip('/')}/quern-{uuid.uuid4().hex}")
    return _written[-1]


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in pieces of at most `limit` bytes of `column` (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.frombuffer(_offsets(batch.column(column)), dtype=_offset_type(batch.column(column)))
        ends = ends[batch.column(column).offset : batch.column(column).offset + batch.num_rows + 1]
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def _offset_type(array: pa.Array) -> type:
    return np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32


def _offsets(array: pa.Array) -> pa.Buffer:
    return array.buffers()[1]


def flat_text(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, and n + 1 offsets into them; null counts as empty."""
    if array.null_count:
        array = array.fill_null("")
    ends = np.frombuffer(_offsets(array), dtype=_offset_type(array))[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = array.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary values that share `data`; offsets has one entry more than there are values."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start..start+length-1 of each range, one after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def crc32_mod(ids: pa.Array, mod: int) -> np.ndarray:
    """crc32 of each id's decimal text, modulo `mod`."""
    return np.fromiter((zlib.crc32(str(x).encode()) % mod for x in ids.to_pylist()), np.int64, len(ids))


def arrow_map(df: DataFrame, fn: Callable, schema) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)
