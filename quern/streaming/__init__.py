"""Datasets over streams of files: row-local operators apply unchanged, writes go to a checkpointed query.

Operators that need all rows (order_by, except_, aggregate to one row, scalar subqueries) stay batch-only.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from quern.operators.dataset import Dataset
from quern.types import kind_of, nullable, require, schema


def read_stream(spark: SparkSession, path: str, model: Any, format: str = "parquet", files_per_batch: int | None = None) -> Dataset:
    """New files of a folder as an unbounded dataset of a model."""
    reader = spark.readStream.schema(nullable(schema(model))).format(format)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return Dataset.of_df(reader.load(path), kind_of(model))


def write_stream(ds: Dataset, path: str, checkpoint: str, format: str = "parquet", once: bool = True) -> StreamingQuery:
    """Append to a folder; `once` handles what is there and stops. The checkpoint folder makes restarts exactly-once."""
    require(ds.frame.isStreaming, "a batch dataset is written by quern.sources.write")
    writer = ds.to_df().writeStream.format(format).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start(path)
