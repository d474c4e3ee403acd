"""Text quality by a factorisation machine over hashed words and structure statistics."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.runtime import arrow_map, flat_text, ragged, ship
from quern.llm.shingles import few
from quern.llm.words import split_words

#: Hashed word features; structure statistics follow them.
WORDS = 1 << 15
_STATS = 14
SIZE = WORDS + _STATS
#: Labelled rows that a model is fitted on at most.
SAMPLE = 6000


@dataclass
class Features:
    """Sparse rows: columns and values of all documents in order, n + 1 offsets."""

    columns: np.ndarray
    values: np.ndarray
    offsets: np.ndarray


def _share(data: np.ndarray, bounds: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Flagged bytes of each text over its bytes."""
    total = np.concatenate([[0], np.cumsum(flags[data])])[bounds]
    return np.diff(total) / np.maximum(1, np.diff(bounds))


def _flags(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, np.int64)
    for a, b in ranges:
        out[a : b + 1] = 1
    return out


_KINDS = (
    _flags((ord("a"), ord("z"))),
    _flags((ord("A"), ord("Z"))),
    _flags((ord("0"), ord("9"))),
    _flags((128, 255)),
    _flags((ord(" "), ord(" "))),
    _flags((ord("\n"), ord("\n"))),
    _flags((ord("."), ord(".")), (ord(","), ord(","))),
    _flags((ord("#"), ord("&")), (ord("*"), ord("*")), (ord("@"), ord("@")), (ord("|"), ord("|")), (ord("~"), ord("~")), (ord("<"), ord(">"))),
    _flags((ord("!"), ord("!")), (ord("?"), ord("?"))),
)


def features(texts: pa.Array) -> Features:
    """Words by hash with weight log(1 + occurrences), scaled to length 1, then structure statistics, each about 0 to 1."""
    words = split_words(texts, lower=True)
    docs, sizes = len(texts), np.diff(words.docs)
    doc = np.repeat(np.arange(docs, dtype=np.int64), sizes)
    hashed = (words.hashes() >> np.uint64(20)).astype(np.int64) % WORDS
    keys, tf = np.unique(doc * len(words.dictionary) + words.codes, return_counts=True)
    owner = keys // max(1, len(words.dictionary))
    distinct = np.bincount(owner, minlength=docs)
    most = np.zeros(docs)
    np.maximum.at(most, owner, tf)
    weight = np.log1p(tf)
    weight /= np.sqrt(np.bincount(owner, weight**2, docs))[owner]
    data, bounds = flat_text(texts)
    again = np.bincount(doc[1:][(words.codes[1:] == words.codes[:-1]) & (doc[1:] == doc[:-1])], minlength=docs) if len(doc) > 1 else np.zeros(docs)
    n = np.maximum(1, sizes)
    stats = [np.log1p(np.diff(bounds)) / 12, distinct / n, most / n, again / n, np.minimum(1, np.diff(bounds) / n / 20), *(_share(data, bounds, k) for k in _KINDS)]
    # rows: the words of a document, then its statistics
    offsets = np.concatenate([[0], np.cumsum(distinct + _STATS)])
    columns, values = np.empty(offsets[-1], np.int32), np.empty(offsets[-1], np.float32)
    at = ragged(offsets[:-1], distinct)
    columns[at], values[at] = hashed[keys % max(1, len(words.dictionary))], weight
    for k, stat in enumerate(stats):
        columns[offsets[1:] - _STATS + k], values[offsets[1:] - _STATS + k] = WORDS + k, stat
    return Features(columns, values, offsets)


class Machine:
    """bias + sum of w x + 1/2 sum over factors of ((sum of v x)^2 - sum of (v x)^2): pairwise interactions in linear time."""

    def __init__(self, factors: int = 8, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.bias, self.w, self.v = 0.0, np.zeros(SIZE, np.float32), rng.normal(0, 0.05, (SIZE, factors)).astype(np.float32)
        self.mean, self.scale = np.zeros(_STATS, np.float32), np.ones(_STATS, np.float32)

    def _standard(self, x: Features) -> Features:
        stat = x.columns >= WORDS
        k = x.columns[stat] - WORDS
        values = x.values.copy()
        values[stat] = np.clip((values[stat] - self.mean[k]) / self.scale[k], -5, 5)
        return Features(x.columns, values, x.offsets)

    def _sums(self, x: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts = x.offsets[:-1]
        vx = self.v[x.columns] * x.values[:, None]
        total = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat(vx * vx, starts, axis=0)
        linear = np.add.reduceat(self.w[x.columns] * x.values, starts)
        return self.bias + linear + 0.5 * (total**2 - squares).sum(axis=1), total, vx

    def probability(self, x: Features) -> np.ndarray:
        """Of label 1, for each row."""
        if len(x.offsets) < 2:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self._sums(self._standard(x))[0].astype(np.float64), -30, 30)))

    def fit(self, x: Features, y: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.02, decay: float = 1e-4, seed: int = 5) -> Machine:
        """Adam on the logistic loss, in small batches; statistics are standardised by the sample's mean and spread."""
        stat = x.columns >= WORDS
        table = x.values[stat].reshape(-1, _STATS)
        self.mean, self.scale = table.mean(axis=0), table.std(axis=0) + 1e-3
        x = self._standard(x)
        self.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        rng, step = np.random.default_rng(seed), 0
        moments = [np.zeros_like(self.w), np.zeros_like(self.w), np.zeros_like(self.v), np.zeros_like(self.v)]
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for a in range(0, len(order), batch):
                rows = order[a : a + batch]
                sizes = np.diff(x.offsets)[rows]
                at = ragged(x.offsets[rows], sizes)
                part = Features(x.columns[at], x.values[at], np.concatenate([[0], np.cumsum(sizes)]))
                logit, total, vx = self._sums(part)
                miss = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[rows]) / len(rows)
                own = np.repeat(np.arange(len(rows)), sizes)
                pull = (miss[own] * part.values)[:, None]
                used, back = np.unique(part.columns, return_inverse=True)
                grad_w = np.bincount(back, pull[:, 0], len(used)) + decay * self.w[used]
                grad_v = np.zeros((len(used), self.v.shape[1]), np.float32)
                np.add.at(grad_v, back, pull * (total[own] - vx))
                grad_v += decay * self.v[used]
                step += 1
                pace = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for value, grad, m, s in ((self.w, grad_w, *moments[:2]), (self.v, grad_v, *moments[2:])):
                    m[used] = 0.9 * m[used] + 0.1 * grad
                    s[used] = 0.999 * s[used] + 0.001 * grad**2
                    value[used] -= pace * m[used] / (np.sqrt(s[used]) + 1e-8)
                self.bias -= rate * 0.1 * float(miss.sum())
        return self


def _training_rows(docs: DataFrame, labels: DataFrame, folds: int, sample: int) -> DataFrame:
    """At most `sample` labelled texts (doc_id, text, quality) outside the held-out fold, the same ones at every run: those with the smallest hash of their id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != 0)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])  # at most `sample` pairs of numbers


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, sample: int = SAMPLE) -> Machine:
    """A machine fitted on a bounded sample of labelled rows; without labels it says 0.5 for every text."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            x = features(batch.column("text"))
            ends = pa.array(x.offsets.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.ListArray.from_arrays(ends, pa.array(x.columns)), pa.ListArray.from_arrays(ends, pa.array(x.values))], names=["doc_id", "quality", "columns", "values"])

    rows = _training_rows(docs, labels, folds, sample)
    found = arrow_map(rows.select("doc_id", "quality", "text"), extract, "doc_id long, quality int, columns array<int>, values array<float>").toArrow().sort_by("doc_id")
    machine = Machine()
    if found.num_rows:
        columns, values = found["columns"].combine_chunks(), found["values"].combine_chunks()
        machine.fit(Features(columns.flatten().to_numpy(), values.flatten().to_numpy(), np.concatenate([[0], np.cumsum(columns.value_lengths().to_numpy())]).astype(np.int64)), found["quality"].to_numpy().astype(np.float64))
    return machine


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3, sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out (crc32 of the id's text modulo `folds` is 0), score (probability of label 1), predicted (score >= threshold).

    The model is a factorisation machine fitted on the driver from the features of at most `sample` labelled rows that are
    not held out (a documented bound; the features of one row are at most its distinct words). Inputs are hashed words
    and structure statistics of the text alone. Null and empty texts get the score of a text without words; a null id
    counts as the text "None" for `held_out`; repeated rows get equal scores; of repeated labels the larger one counts.
    Other columns are not read. An empty table gives an empty result.
    """
    docs = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    ship(docs.sparkSession)
    machine = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds, sample))  # fixed size: SIZE rows of factors + 1 float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            score = machine.value.probability(features(batch.column("text")))
            held = np.fromiter((zlib.crc32(str(x).encode()) % folds == 0 for x in batch.column("doc_id").to_pylist()), np.bool_, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return arrow_map(docs, run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """The rows of `docs` (doc_id, text and any other columns) whose text scores at least `threshold`, by the same model as score_quality."""
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    ship(docs.sparkSession)
    machine = docs.sparkSession.sparkContext.broadcast(train(plain, labels, folds, sample))  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            yield batch.filter(pa.array(machine.value.probability(features(batch.column("text"))) >= threshold))

    return arrow_map(docs, run, docs.schema)
