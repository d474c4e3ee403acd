"""Near-duplicate texts: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.cap_filters import _roots
from quern.llm.graph import components
from quern.llm.runtime import arrow_map, materialise, ship
from quern.llm.shingles import BITS, SHINGLE_BYTES, SKETCH, Shingles, few, frequencies, idf, shingles

#: Entries of the pool that the sampler's random numbers are drawn from.
_POOL = 1 << 16
#: Buckets up to this size have all their pairs verified one by one; larger ones are compared with representatives first.
_SMALL = 16
_SALTS = 4
#: Texts in each side of a block of a large bucket, on average.
_SIDE = 128


class Sampler:
    """`samples` consistent samples of a weighted set: equal with the probability of the sets' weighted Jaccard similarity."""

    def __init__(self, samples: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.r = rng.gamma(2, 1, _POOL).astype(np.float32)
        self.log_c = np.log(rng.gamma(2, 1, _POOL)).astype(np.float32)
        self.beta = rng.random(_POOL, np.float32)
        self.odd = rng.integers(1, 2**63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sample(self, sets: Shingles, weights: np.ndarray) -> np.ndarray:
        """One row per document that has shingles, one column per sample."""
        starts = sets.docs[:-1][np.diff(sets.docs) > 0]
        sizes = np.diff(np.append(starts, len(sets.hash)))
        log_w = np.log(weights).astype(np.float32)
        out = np.empty((len(starts), len(self.odd)), np.uint64)
        for j, odd in enumerate(self.odd):
            at = ((sets.hash * odd) >> np.uint64(48)).astype(np.int64)
            r, beta = self.r.take(at), self.beta.take(at)
            t = np.floor(log_w / r + beta)
            log_a = self.log_c.take(at) - r * (t - beta) - r
            least = np.minimum.reduceat(log_a, starts)
            hit = np.flatnonzero(log_a == np.repeat(least, sizes))
            hit = hit[np.searchsorted(hit, starts)]  # the first of equals
            key = (sets.hash[hit] ^ (t[hit].astype(np.int64).astype(np.uint64) << np.uint64(52))) * odd
            out[:, j] = key ^ (key >> np.uint64(31))
        return out


def weigh(sets: Shingles, idfs: np.ndarray) -> np.ndarray:
    return sets.tf * idfs[(sets.hash & np.uint64(SKETCH - 1)).astype(np.int64)]


def similarity(left: Shingles, right: Shingles, idfs: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of each left document with the right one of the same number; 0 if either is empty."""
    n = len(left.docs) - 1
    keys = [(s.doc.astype(np.uint64) << np.uint64(BITS)) | s.hash for s in (left, right)]
    if not len(keys[0]) or not len(keys[1]):
        return np.zeros(n)
    at = np.minimum(np.searchsorted(keys[0], keys[1]), len(keys[0]) - 1)
    same = keys[0][at] == keys[1]
    a, b = weigh(left, idfs), weigh(right, idfs)
    total = np.bincount(left.doc, a, n) + np.bincount(right.doc, b, n)
    common = np.bincount(right.doc[same], np.minimum(a[at[same]], b[same]), n)
    return np.divide(common, total - common, out=np.zeros(n), where=total > common)


def _verify(docs: DataFrame, pairs: DataFrame, idfs, threshold: float, width: int) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough, one text of each side at a time."""
    near = pairs.join(docs.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    near = near.join(docs.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches, "text_a", SHINGLE_BYTES):
            for piece in few(iter([batch]), "text_b", SHINGLE_BYTES):
                score = similarity(shingles(piece.column("text_a"), width), shingles(piece.column("text_b"), width), idfs.value)
                good = pa.array(score >= threshold)
                yield pa.RecordBatch.from_arrays([piece.column(c).filter(good) for c in ("a", "b")] + [pa.array(score).filter(good)], names=["a", "b", "similarity"])

    return arrow_map(near, run, "a long, b long, similarity double")


def _similarities(left: Shingles, right: Shingles, idfs: np.ndarray) -> np.ndarray:
    """`similarity` of every left document with every right one."""
    n, m = len(left.docs) - 1, len(right.docs) - 1
    names, at = np.unique(np.concatenate([left.hash, right.hash]), return_inverse=True)
    mine, other = at[: len(left.hash)], at[len(left.hash) :]
    out = np.zeros((n, m))
    a, b = weigh(left, idfs), weigh(right, idfs)
    sums, totals = np.bincount(left.doc, a, n), np.bincount(right.doc, b, m)
    held = np.zeros(len(names))
    for k in range(n):
        own = slice(left.docs[k], left.docs[k + 1])
        held[mine[own]] = a[own]
        common = np.bincount(right.doc, np.minimum(held[other], b), m)
        held[mine[own]] = 0
        total = sums[k] + totals - common
        out[k] = np.divide(common, total, out=np.zeros(m), where=total > 0)
    return out


def _block_links(docs: DataFrame, labelled: DataFrame, idfs, threshold: float, width: int) -> DataFrame | None:
    """Links (a, b) that join what similar pairs join, over all pairs of a bucket whose texts are in different classes.

    A bucket's strays are the texts outside its commonest class. Strays and the others are cut into sides by hash, and
    each pair of sides with strays in one of them is a block, so a bucket of one class costs nothing. None where every bucket is of one class.
    """
    bucket = ["band", "key"]
    classes = labelled.groupBy(*bucket, "component").agg(F.count(F.lit(1)).alias("n"))
    mains = materialise(classes.groupBy(*bucket).agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("classes")).where("classes > 1").drop("classes"))
    if mains.isEmpty():
        return None
    members = materialise(labelled.join(mains, bucket).select(*bucket, "doc_id", (F.col("component") != F.col("main")).alias("stray")))
    texts = docs.join(members.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    members = materialise(members.join(texts, "doc_id"))
    sides = lambda chosen: F.ceil(F.greatest(F.sum(F.when(chosen, 1).otherwise(0)) / _SIDE, F.sum(F.when(chosen, F.octet_length("text")).otherwise(0)) / SHINGLE_BYTES)).cast("int")
    cuts = materialise(members.groupBy(*bucket).agg(sides(F.col("stray")).alias("strays"), sides(~F.col("stray")).alias("others")))
    hashed = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    rows = members.join(cuts, bucket).withColumn("side", F.when(F.col("stray"), hashed("strays")).otherwise(F.col("strays") + hashed("others")))
    last = F.when(F.col("stray"), F.col("strays") + F.col("others")).otherwise(F.col("strays")) - 1
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.select(*bucket, "doc_id", "text", "side", F.least("side", "with").alias("low"), F.greatest("side", "with").alias("high"))

    def verify(table: pa.Table) -> pa.Table:
        side, low, high = (table[c].to_numpy() for c in ("side", "low", "high"))
        name, text = table["doc_id"].to_numpy(), table["text"].combine_chunks()
        i, j = np.flatnonzero(side == low), np.flatnonzero(side == high)
        sets = [shingles(text.take(pa.array(k)), width) for k in ((i,) if low[0] == high[0] else (i, j))]
        linked = _similarities(sets[0], sets[-1], idfs.value) >= threshold
        left, right = _roots(linked, name[i], name[j])
        a, b = np.concatenate([name[i], name[j]]), np.concatenate([left, right])
        return pa.table({"a": a[a != b], "b": b[a != b]})

    ship(docs.sparkSession)
    return materialise(rows.groupBy(*bucket, "low", "high").applyInArrow(verify, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = 5, bands: int = 10, rows: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, class_id (smallest doc_id that links lead to, itself included), kept (doc_id = class_id), one row per row of `docs`.

    Texts link where the weighted Jaccard similarity of their shingles of `width` words is at least `threshold`; weights
    are occurrences times a bounded idf over all documents. Equal texts with words are one class at once. Samples are
    banded (`bands` keys of `rows` samples), so a pair at similarity s is a candidate with probability
    1 - (1 - s^rows)^bands. All pairs of a bucket of up to 16 texts are verified. Of a larger one, every text is verified
    with the bucket's most central text (the one that shares most buckets of that kind), then texts still in another class with the
    most central of each of 4 salts, and then all pairs whose texts are still in different classes, in blocks that return
    block-wise roots, never pairs. So every pair of a bucket is compared or already in one class.

    Null and empty texts and texts without words are classes of their own. A row with a null id takes part in nothing and
    has a null class. Repeated rows share a class. Other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    idfs = spark.sparkContext.broadcast(idf(frequencies(docs, width)))  # SKETCH float32 values, 4 MB at any input
    sampler = Sampler(bands * rows)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches, limit=SHINGLE_BYTES):
            sets = shingles(batch.column("text"), width)
            full = np.flatnonzero(np.diff(sets.docs) > 0)
            keys = np.zeros((len(full), bands), np.uint64)
            if len(full):
                samples = sampler.sample(sets, weigh(sets, idfs.value))
                for band in range(bands):
                    for k in range(rows):
                        keys[:, band] = (keys[:, band] ^ samples[:, band * rows + k]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band + 1)
                        keys[:, band] ^= keys[:, band] >> np.uint64(32)
            counts = np.zeros(batch.num_rows, np.int32)
            counts[full] = bands
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(keys.ravel().view(np.int64)))
            same = [hashlib.md5(t.as_buffer()).digest() if has else None for t, has in zip(batch.column("text"), counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(same, pa.binary()), lists], names=["doc_id", "same", "keys"])

    signed = materialise(arrow_map(docs, sign, "doc_id long, same binary, keys array<long>"))
    known = signed.where(F.col("doc_id").isNotNull())
    texts = known.where(F.col("same").isNotNull()).groupBy("same")
    texts = materialise(texts.agg(F.min("doc_id").alias("first"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("copies")))

    entries = texts.select(F.col("first").alias("doc_id"), F.posexplode("keys").alias("band", "key"))
    sizes = materialise(entries.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    entries = materialise(entries.join(sizes, ["band", "key"]))
    small, large = entries.where(F.col("size") <= _SMALL), entries.where(F.col("size") > _SMALL)
    large = materialise(large.join(large.groupBy("doc_id").agg(F.sum("size").alias("central")), "doc_id"))

    other = small.select("band", "key", F.col("doc_id").alias("other"))
    within = small.join(other, ["band", "key"]).where("doc_id < other").select(F.col("doc_id").alias("a"), F.col("other").alias("b"))
    leaders = materialise(large.groupBy("band", "key").agg(F.max_by("doc_id", F.struct("central", -F.col("doc_id"))).alias("leader")))
    led = large.join(leaders, ["band", "key"]).where("doc_id != leader").select(F.least("doc_id", "leader").alias("a"), F.greatest("doc_id", "leader").alias("b"))
    pairs = materialise(within.unionAll(led).distinct())
    links = materialise(_verify(docs, pairs, idfs, threshold, width))
    classes = components(links)

    if not large.isEmpty():
        labelled = materialise(large.join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")))
        leaders = materialise(labelled.groupBy("band", "key", (F.xxhash64("doc_id") % _SALTS).alias("salt")).agg(F.max_by(F.struct("doc_id", "component"), F.struct("central", -F.col("doc_id"))).alias("leader")))
        led = labelled.join(leaders, ["band", "key"]).where(F.col("component") != F.col("leader.component"))
        led = led.select(F.least("doc_id", "leader.doc_id").alias("a"), F.greatest("doc_id", "leader.doc_id").alias("b")).distinct()
        led = materialise(led.join(pairs, ["a", "b"], "left_anti"))
        if not led.isEmpty():
            more = materialise(_verify(docs, led, idfs, threshold, width))
            links = links.unionAll(more)
            classes = components(links)
            labelled = materialise(large.join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")))
        rest = _block_links(docs, labelled, idfs, threshold, width)
        if rest is not None:
            classes = components(links.select("a", "b").unionAll(rest))

    copied = texts.where("copies > 1").select("same", "first")
    known = known.join(copied, "same", "left").select("doc_id", F.coalesce("first", "doc_id").alias("first"))
    reached = known.join(classes.select(F.col("node").alias("first"), "component"), "first", "left")
    found = reached.select("doc_id", F.coalesce("component", "first").alias("class_id"))
    return found.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept")).unionAll(
        signed.where(F.col("doc_id").isNull()).select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept"))
    )
