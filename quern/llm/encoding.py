"""Byte-level BPE encoding and decoding of whole texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.bpe import encoder
from quern.llm.runtime import arrow_map, flat_text, slices

#: Columns that encode_documents can give besides doc_id.
OUTPUTS = {
    "n_tokens": "long",
    "ids": "array<int>",
    "offsets": "array<int>",
    "decoded": "binary",
    "ids_sha256": "string",
    "decoded_sha256": "string",
}


def encode_documents(docs: DataFrame, path: str, outputs: tuple[str, ...] = ("n_tokens", "ids", "offsets", "decoded"), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Token ids of each text, the byte offset at which each token begins, and the bytes that decoding the ids gives.

    Other columns are not read, so their names can't clash. A null or empty text has no tokens; rows with a null id and
    repeated rows are encoded like any others; an empty table gives an empty result. `path` names a rank file or a
    tokenizer file on the executors' machines. The digests are of the decimal ids joined by commas and of the decoded bytes.
    """
    schema = "doc_id long, " + ", ".join(f"{c} {OUTPUTS[c]}" for c in outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        digits = pa.array([b"%d," % k for k in range(len(own.vocabulary.tokens))], pa.binary())
        for batch in slices(batches):
            enc = own.encode(batch.column("text"))
            raw, at = own.decode(enc.ids)
            cuts = enc.tokens
            columns: dict[str, pa.Array] = {"doc_id": batch.column("doc_id")}
            for name in outputs:
                if name == "n_tokens":
                    columns[name] = pa.array(np.diff(cuts))
                elif name == "ids":
                    columns[name] = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(enc.ids))
                elif name == "offsets":
                    columns[name] = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array((at[:-1] - np.repeat(at[cuts[:-1]], np.diff(cuts))).astype(np.int32)))
                elif name == "decoded":
                    columns[name] = pa.array([raw[at[a] : at[b]].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
                elif name == "ids_sha256":
                    said, to = flat_text(digits.take(pa.array(enc.ids)))
                    columns[name] = pa.array([hashlib.sha256(said[to[a] : max(to[a], to[b] - 1)]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
                else:
                    columns[name] = pa.array([hashlib.sha256(raw[at[a] : at[b]]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return arrow_map(docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text")), run, schema)
