"""Shingles of words and their idf, taken from a document-frequency sketch of fixed size."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.runtime import SLICE_BYTES, arrow_map, ship, slices
from quern.llm.words import split_words

#: Bits of a shingle's hash. The document number takes the others while a batch is sorted.
BITS = 50
_MASK = np.uint64((1 << BITS) - 1)
#: Documents handled at once, as the document number has 14 bits.
_MOST = 1 << 13
#: Text bytes shingled at once; their hashes, samples and sorts take several times as much.
SHINGLE_BYTES = 4 << 20
#: Counters of the sketch, in blocks that are summed apart.
SKETCH, _BLOCK = 1 << 20, 1 << 14


@dataclass
class Shingles:
    """Distinct shingles, sorted by document and hash: document number, hash, occurrences; docs: n + 1 offsets."""

    doc: np.ndarray
    hash: np.ndarray
    tf: np.ndarray
    docs: np.ndarray


def shingles(texts: pa.Array, width: int = 5) -> Shingles:
    """Every run of `width` words; a text of fewer words has one shingle, of all of them; one without words has none."""
    words = split_words(texts)
    n, sizes = len(words.codes), np.diff(words.docs)
    hashes = np.concatenate([words.hashes()[words.codes], np.zeros(width, np.uint64)])
    odd = np.arange(1, 2 * width, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += hashes[k : k + n] * odd[k]
    doc = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    place = np.arange(n) - np.repeat(words.docs[:-1], sizes)
    valid = place + width <= np.repeat(sizes, sizes)
    for k in np.flatnonzero((sizes > 0) & (sizes < width)):
        at = words.docs[k]
        total[at] = np.dot(hashes[at : at + sizes[k]], odd[: sizes[k]]) + np.uint64(sizes[k])
        valid[at] = True
    total, doc = total[valid], doc[valid]
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(32)
    keys = np.sort((doc << np.uint64(BITS)) | (total >> np.uint64(64 - BITS)))
    fresh = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    tf = np.diff(np.append(fresh, len(keys)))
    keys = keys[fresh]
    doc = (keys >> np.uint64(BITS)).astype(np.int64)
    return Shingles(doc, keys & _MASK, tf, np.searchsorted(doc, np.arange(len(sizes) + 1)))


def few(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices by bytes that also have few enough rows for one sort."""
    for batch in slices(batches, column, limit):
        for at in range(0, batch.num_rows, _MOST):
            yield batch.slice(at, _MOST)


def frequencies(docs: DataFrame, width: int = 5) -> np.ndarray:
    """Relative document frequency by shingle hash modulo SKETCH, over all texts.

    The sketch has a fixed size (SKETCH counters, 4 MB) at any input: its partial sums are combined by block and its
    resolution is relative, about (shingles a document) / SKETCH of the documents.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(SKETCH, np.int64), 0
        for batch in few(batches, limit=SHINGLE_BYTES):
            counts += np.bincount((shingles(batch.column("text"), width).hash & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
            rows += batch.num_rows
        blocks = range(SKETCH // _BLOCK if rows else 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*blocks], pa.int32()), pa.array([rows if b == 0 else 0 for b in blocks], pa.int64()), pa.array([counts[b * _BLOCK : (b + 1) * _BLOCK].astype("<u4").tobytes() for b in blocks], pa.binary())], names=["block", "docs", "counts"]
        )

    def total(table: pa.Table) -> pa.Table:
        counts = sum((np.frombuffer(x, "<u4").astype(np.uint64) for x in table["counts"].to_pylist()), np.zeros(_BLOCK, np.uint64))
        return pa.table({"block": table["block"][:1], "docs": pa.array([sum(table["docs"].to_pylist())], pa.int64()), "counts": pa.array([counts.astype("<u8").tobytes()], pa.binary())})

    ship(docs.sparkSession)
    schema = "block int, docs long, counts binary"
    rows = arrow_map(docs.select("text"), partial, schema).groupBy("block").applyInArrow(total, schema).collect()
    out = np.zeros(SKETCH)
    for r in rows:
        out[r.block * _BLOCK : (r.block + 1) * _BLOCK] = np.frombuffer(r.counts, "<u8")
    return out / max(1, sum(r.docs for r in rows))


def idf(frequency: np.ndarray, spread: float = 0.25, floor: float = 2.0**-12) -> np.ndarray:
    """1 for a shingle of every document up to 1 + spread for one of at most `floor` of them: a smooth, bounded idf.

    The bound keeps weighted and plain similarity close where a large share of all documents are copies of one another.
    """
    return (1 + spread * np.log(np.clip(frequency, floor, 1)) / np.log(floor)).astype(np.float32)
