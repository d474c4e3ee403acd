"""A corpus pipeline of five operators: each stage is written as Parquet and read again as the next one's documents.

All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import personal_data, quality_model, quality_rules
from quern.llm.minhash import near_duplicates
from quern.llm.packing import pack_documents
from quern.llm.runtime import materialise

#: The stages draw on a fitted model, samples and tokens, so no SQL states the result.
ORACLE_SQL = None


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    return quality_model.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality rules reject."""
    return quality_rules.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates. Rows are told apart by numbers of their own, so repeated and null ids lose no text."""
    row = "row_number" + "_" * max(map(len, docs.columns))
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()))
    kept = near_duplicates(numbered, id_column=row).where("kept").select(F.col("doc_id").alias(row))
    return numbered.join(kept, row, "left_semi").select(docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in brackets; n_chars follows."""
    found = personal_data.extract(docs, carry=True)
    text = personal_data.redact(F.col("row.text"), F.concat("base", "found"))
    named = {"text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*(named.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens, as pieces of documents with their ids."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), size=2048, end=1)


STAGES = [
    ("quality classifier", classify),
    ("quality rules", apply_rules),
    ("MinHash near-dedup", drop_near_duplicates),
    ("PII", redact_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from `documents` to pieces of sequences."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
