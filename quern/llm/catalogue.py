"""The operators' queries: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import oracles
from quern.llm.cap_filters import link_vectors
from quern.llm.encoding import encode_documents
from quern.llm.language_model import score_documents
from quern.llm.minhash import near_duplicates
from quern.llm.packing import pack_documents
from quern.llm.personal_data import KINDS, extract, said
from quern.llm.quality_model import score_quality
from quern.llm.quality_rules import judge
from quern.llm.token_counts import count_tokens
from quern.llm.url_templates import judge_urls


#: Verdicts by host and start of the path; a rule holds for all subdomains of its host, and the longest one that fits decides.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), size=2048, end=1, keep_ids=False)


def op2_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(_read(spark, sf_dir, "embeddings"), threshold=0.9, filters_each=24)


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(_read(spark, sf_dir, "documents"), rounds=3, confidence=0.8, support=4)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(F.concat("base", "found")).alias("spans"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"), threshold=0.8, width=5, bands=10, rows=4)


def op5_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_read(spark, sf_dir, "pages"), URL_RULES)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(_read(spark, sf_dir, "documents"))
    return found.drop("class_distance", "word_distance")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), folds=5, threshold=0.3)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_read(spark, sf_dir, "documents"), folds=10, mu=100.0, nu=2.0, add=0.1)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_packing, op2_cap_filters, op3_personal_data, op4_minhash, op5_url_templates, op6_quality_rules, op7_byte_bpe, op8_quality_classifier, op9_token_counts, op10_language_model, pipeline]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_cap_filters": oracles.CAP_FILTERS, "op6_quality_rules": oracles.QUALITY_RULES}
