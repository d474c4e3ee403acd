"""Token counts of whole texts through a compiled finite-state transducer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quern.llm.runtime import arrow_map, slices
from quern.llm.transducer import counter


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of each text.

    Other columns are not read, so their names can't clash. A null or empty text has 0 bytes and 0 tokens; null ids and
    repeated rows are kept as they are; an empty table gives an empty result. `path` names a rank file or a byte-level
    BPE tokenizer file on the executors' machines; special strings of the latter count as one token each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in slices(batches):
            texts = batch.column("text")
            tokens = own.count(texts)
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(tokens, pa.int64()), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return arrow_map(docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text")), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
