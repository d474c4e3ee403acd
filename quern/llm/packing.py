"""Bounded-space online packing of documents into sequences of a fixed number of tokens."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.bpe import encoder
from quern.llm.runtime import arrow_map, materialise, ship, slices

_PIECE = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("ids", pa.list_(pa.int32())),
        ("open", pa.bool_()),
        ("slot", pa.int64()),
        ("part", pa.int64()),
    ]
)
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>, open boolean, slot long, part long"
#: Windows left open by so many partitions are merged by one task; the levels of merging grow with the logarithm of the partitions.
FAN_IN = 64


class Packer:
    """A fixed number of open windows. A window is a list of (doc_id, start, ids, doc_tokens) with its room."""

    def __init__(self, size: int, windows: int, least_cut: int, level: int, part: int, keep_ids: bool):
        self.size, self.least_cut, self.keep_ids = size, least_cut, keep_ids
        self.first_id, self.part, self.closed = (level << 60) | (part << 34), part, 0
        self.windows: list[list] = [[] for _ in range(windows)]
        self.room = [size] * windows
        self.rows: list[tuple] = []

    def add(self, doc_id, start: int, ids: np.ndarray, total: int) -> None:
        """Place a piece: full windows are cut off its front, the rest goes to the tightest window that takes it.

        When none takes it, the fullest is emitted, topped up from the front of the piece unless its room is a scrap.
        """
        while len(ids) >= self.size:
            self._emit([(doc_id, start, ids[: self.size], total)])
            start, ids = start + self.size, ids[self.size :]
        while len(ids):
            fits = [(r, k) for k, r in enumerate(self.room) if r >= len(ids)]
            if fits:
                room, k = min(fits)
                cut = len(ids)
            else:
                room, k = min((r, k) for k, r in enumerate(self.room))
                cut = room if room >= self.least_cut else 0
            if cut:
                self.windows[k].append((doc_id, start, ids[:cut], total))
                self.room[k] -= cut
                start, ids = start + cut, ids[cut:]
            if len(ids) or not self.room[k]:
                self._emit(self.windows[k])
                self.windows[k], self.room[k] = [], self.size

    def _emit(self, window: list) -> None:
        self._write(window, self.first_id + self.closed, False)
        self.closed += 1

    def _write(self, window: list, sequence: int, left_open: bool) -> None:
        offset = 0
        for doc_id, start, ids, total in window:
            own = ids if self.keep_ids or left_open else None
            self.rows.append((doc_id, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes()), total, sequence, offset, own, left_open, sequence, self.part))
            offset += len(ids)

    def leave(self) -> None:
        """Hand the open windows on."""
        for k, window in enumerate(self.windows):
            self._write(window, k, True)

    def finish(self) -> None:
        """Run the open windows together, fullest first, cutting at the size: one window at most stays short."""
        pieces = [p for k in sorted(range(len(self.room)), key=lambda k: (self.room[k], k)) for p in self.windows[k]]
        window, room = [], self.size
        for doc_id, start, ids, total in pieces:
            while len(ids):
                cut = min(room, len(ids))
                window.append((doc_id, start, ids[:cut], total))
                start, ids, room = start + cut, ids[cut:], room - cut
                if not room:
                    self._emit(window)
                    window, room = [], self.size
        if window:
            self._emit(window)

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [()] * len(_PIECE)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECE, strict=True)], schema=_PIECE)


def pack_documents(
    docs: DataFrame, path: str, size: int = 2048, windows: int = 16, least_cut: int = 16, end: int | None = 1, keep_ids: bool = True, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Sequences of at most `size` tokens, as pieces of documents that cover every token of every document once.

    Each partition keeps `windows` open windows and places every document online; the windows that stay open are merged
    by a tree of tasks with FAN_IN inputs each, and only the last task's last window can be short for want of tokens.

    doc_id; start, length: the piece among the document's tokens; ids_crc32: of its ids as little-endian unsigned 32-bit
    numbers; doc_tokens; sequence_id, offset: where it lies, gapless from 0; ids unless `keep_ids` is false. `end` follows
    each document if it is not null. Other columns are not read, so their names can't clash. Null and empty texts have
    only the end token (and no piece where `end` is null); null ids and repeated rows are packed like any other; an
    empty table gives no piece.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packer = encoder(path), Packer(size, windows, least_cut, 0, TaskContext.get().partitionId(), keep_ids)
        tail = np.array([] if end is None else [end], np.int32)
        for batch in slices(batches):
            enc = own.encode(batch.column("text"))
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                ids = np.concatenate([enc.ids[enc.tokens[k] : enc.tokens[k + 1]], tail])
                packer.add(doc_id, 0, ids, len(ids))
            yield packer.take()
        packer.leave()
        yield packer.take()

    def merge(level: int, last: bool):
        def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            packer = Packer(size, windows, least_cut, level, key[0].as_py(), keep_ids)
            table = table.sort_by([("part", "ascending"), ("slot", "ascending"), ("offset", "ascending")])
            ids = table["ids"].combine_chunks()
            flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
            for k, (doc_id, start, total) in enumerate(zip(*(table[c].to_pylist() for c in ("doc_id", "start", "doc_tokens")), strict=True)):
                packer.add(doc_id, start, flat[ends[k] : ends[k + 1]], total)
            packer.finish() if last else packer.leave()
            return pa.Table.from_batches([packer.take()])

        return run

    texts = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    found = materialise(arrow_map(texts, first, _DDL))
    done = [found.where(~F.col("open"))]
    level = 0
    while True:
        opened = found.where("open")
        parts = opened.agg(F.max("part")).first()[0]
        if parts is None:
            break
        level += 1
        groups = -(-(parts + 1) // FAN_IN)
        ship(docs.sparkSession)
        grouped = opened.withColumn("group", F.floor(F.col("part") / FAN_IN)).groupBy("group")
        found = materialise(grouped.applyInArrow(merge(level, groups == 1), _DDL))
        done.append(found.where(~F.col("open")))
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out.drop("open", "slot", "part", *([] if keep_ids else ["ids"]))
