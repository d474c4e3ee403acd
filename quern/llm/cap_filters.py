"""Near-duplicate vectors by spherical-cap filters: list-decoded random product codes, a join on filters, exact cosines."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.graph import components
from quern.llm.runtime import arrow_map, materialise, ship

#: Vectors in a bucket on average; vectors in each side of a block of a large bucket; rows for each shard of blocks.
BUCKET, SIDE, SHARD = 512, 1024, 8192
#: Independent product codes that a vector's filters come from: the more, the less the number of filters varies.
REPEATS = 8
_BLOCK_CODES = 4096
#: Bits of a filter's number; the place of the vectors' length among all lengths has those above.
_FILTER_BITS = 40


@dataclass
class ProductCode:
    """`blocks` codes of unit vectors; a filter is one codeword of each, and its direction their concatenation over sqrt(blocks), after a rotation."""

    rotation: np.ndarray
    codes: list[np.ndarray]
    least: float

    @classmethod
    def fit(cls, dimension: int, vectors: int, filters_each: float, seed: int) -> ProductCode:
        """So many filters that a bucket holds about BUCKET vectors if each vector exceeds `filters_each` of them."""
        wanted = max(16.0, vectors * filters_each / BUCKET)
        blocks = 1 if dimension < 8 else 2 if wanted <= _BLOCK_CODES**2 else 3
        each = max(2, math.ceil(wanted ** (1 / blocks)))
        rng = np.random.default_rng(seed)
        rotation = np.linalg.qr(rng.normal(size=(dimension, dimension)))[0]
        codes = []
        for part in np.array_split(np.arange(dimension), blocks):
            code = rng.normal(size=(each, len(part)))
            codes.append(code / np.linalg.norm(code, axis=1, keepdims=True) / math.sqrt(blocks))
        # the share of a sphere in the cap beyond s is the integral of (1 - s^2)^((d - 3) / 2)
        grid = np.linspace(-1, 1, 200_001)[1:-1]
        density = (1 - grid**2) ** ((dimension - 3) / 2)
        beyond = np.cumsum(density[::-1])[::-1] / density.sum()
        return cls(rotation, codes, float(grid[np.searchsorted(-beyond, -min(1.0, filters_each / each**blocks))]))

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters that a row exceeds. Partial sums that the best of the other blocks can't lift are dropped early."""
        turned = unit @ self.rotation
        cuts = np.cumsum([0, *(c.shape[1] for c in self.codes)])
        scores = [turned[:, a:b] @ c.T for a, b, c in zip(cuts[:-1], cuts[1:], self.codes, strict=True)]
        best = [s.max(axis=1) for s in scores]
        row, code, total = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for k, score in enumerate(scores):
            rest = sum(best[k + 1 :], np.zeros(len(unit)))
            sums = total[:, None] + score[row]
            at, word = np.nonzero(sums >= (self.least - rest[row])[:, None])
            row, code, total = row[at], code[at] * score.shape[1] + word, sums[at, word]
        return row, code


def _matrix(lists: pa.Array, dimension: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _membership(lists: list[np.ndarray], below: int) -> tuple[np.ndarray, np.ndarray]:
    flat = np.concatenate([x[x < below] for x in lists])
    return flat, np.repeat(np.arange(len(lists)), [int((x < below).sum()) for x in lists])


def _met_before(left: list[np.ndarray], right: list[np.ndarray], own: int) -> np.ndarray:
    """Whether two rows already share a filter with a smaller number, so that each link counts once."""
    (a, i), (b, j) = _membership(left, own), _membership(right, own)
    names, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.zeros((len(left), len(names)), np.float32), np.zeros((len(right), len(names)), np.float32)
    x[i, back[: len(a)]], y[j, back[len(a) :]] = 1, 1
    return x @ y.T > 0


def _roots(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that links inside a block lead to, for both sides."""
    a, b, most = left.copy(), right.copy(), np.iinfo(np.int64).max
    while True:
        to = np.minimum(b, np.where(linked, a[:, None], most).min(axis=0, initial=most))
        back = np.minimum(a, np.where(linked, to[None, :], most).min(axis=1, initial=most))
        if (to == b).all() and (back == a).all():
            return a, b
        a, b = back, to


def link_vectors(vectors: DataFrame, threshold: float = 0.9, filters_each: float = 24, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, n_links (other vectors with cosine >= threshold found), component_id (smallest vec_id that links lead to), kept (vec_id = component_id), one row per row.

    Equal vectors become one with a multiplicity first, so groups of exact copies cost no more than one of them.
    Candidates share a filter; every candidate pair is verified in double precision, in blocks that return sums and
    block-wise roots, never pairs. Buckets of more than SIDE vectors are cut into sides, and each pair of sides is a block.
    The number of filters grows with the vectors, so an ordinary bucket stays near BUCKET of them. A pair at cosine 0.9
    shares one of 24 expected filters with a probability of about 0.998, one at 0.95 of over 0.999.

    Only vectors of one length are compared; each length has codes of its own, or, with at most SIDE vectors, one bucket
    of all. Vectors that are null, zero, or hold null or non-finite components link with nothing.
    Rows with the same vec_id are vectors of their own. A row with a null id is compared like any other; component_id is
    null only where a component has no id at all, and kept then is true. Other columns are not read. An empty table gives an empty result.
    """
    spark, kind = vectors.sparkSession, vectors.schema[vector_column].dataType.simpleString()
    sound = "v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x != 0)"
    rows = vectors.select(vectors[id_column].cast("long").alias("own_id"), vectors[vector_column].alias("v")).select("own_id", F.when(F.expr(sound), F.col("v")).alias("v"))
    rows = rows.withColumns({"h": F.when(F.col("v").isNotNull(), F.xxhash64("v")), "g": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(7), "v"))})
    same = rows.where("v IS NOT NULL").groupBy("h", "g").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"), F.min("own_id").alias("least"))
    ids = materialise(same.select(F.monotonically_increasing_id().alias("vec_id"), "*"))  # vec_id: a number for each distinct vector
    lengths = ids.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()  # one row for each length
    alone = rows.select(F.col("own_id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("own_id").alias("component_id"), F.lit(True).alias("kept"))
    if not lengths:
        return alone
    place = {d: k for k, (d, _) in enumerate(lengths)}
    codes = {d: [ProductCode.fit(d, n, filters_each / REPEATS, seed) for seed in range(REPEATS)] for d, n in lengths if n > SIDE}
    code = spark.sparkContext.broadcast(codes)  # for each common length at most 3 x 4,096 codewords each

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("v").value_lengths().to_numpy()
            for d in np.unique(sizes).tolist():
                own = batch.take(pa.array(np.flatnonzero(sizes == d)))
                for k in range(0, own.num_rows, 512):
                    part = own.slice(k, 512)
                    if d in code.value:
                        unit = _unit(_matrix(part.column("v"), d))
                        decoded = [(row, found * REPEATS + r) for r, c in enumerate(code.value[d]) for row, found in [c.decode(unit)]]
                        row, found = (np.concatenate(x) for x in zip(*decoded, strict=True))
                    else:
                        row, found = np.arange(part.num_rows), np.zeros(part.num_rows, np.int64)
                    order = np.argsort(row, kind="stable")
                    row, found = row[order], found[order] + (place[d] << _FILTER_BITS)
                    cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("vec_id", "copies", "v")), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(found))], names=["vec_id", "copies", "v", "filters"])

    decoded = materialise(arrow_map(ids.select("vec_id", "copies", "v"), decode, f"vec_id long, copies long, v {kind}, filters array<long>"))
    met = decoded.select("vec_id", F.explode("filters").alias("filter"))
    sizes = materialise(met.groupBy("filter").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("filter", F.ceil(F.col("n") / SIDE).cast("int").alias("sides")))
    shared = met.join(sizes, "filter").groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("filter", "sides"))).alias("shared"))
    met_rows = decoded.select("vec_id", "copies", "v").join(shared, "vec_id").select("vec_id", "copies", "v", F.col("shared.filter").alias("filters"), F.explode("shared").alias("own"))
    side = F.pmod(F.xxhash64("vec_id"), F.col("own.sides")).cast("int")
    met_rows = met_rows.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("own.sides") - 1)))
    met_rows = met_rows.select("vec_id", "copies", "v", "filters", F.col("own.filter").alias("filter"), "side", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"))
    total = sizes.count() and met.join(sizes, "filter").agg(F.sum("sides")).first()[0]
    shards = max(1, math.ceil((total or 0) / SHARD))

    def verify(table: pa.Table) -> pa.Table:
        table = table.sort_by([("filter", "ascending"), ("low", "ascending"), ("high", "ascending"), ("side", "ascending"), ("vec_id", "ascending")])
        name, copies, vectors = table["vec_id"].to_numpy(), table["copies"].to_numpy(), table["v"].combine_chunks()
        own, low, high, side = (table[c].to_numpy() for c in ("filter", "low", "high", "side"))
        lists = table["filters"].combine_chunks()
        flat, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        edge = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
        nodes, roots, counts = [], [], []
        for a, b in zip(edge, np.append(edge[1:], len(name)), strict=True):
            same = low[a] == high[a]
            middle = a if same else a + int(np.searchsorted(side[a:b], high[a]))
            i, j = (np.arange(a, b),) * 2 if same else (np.arange(a, middle), np.arange(middle, b))
            unit = _unit(_matrix(vectors.slice(a, b - a), lengths[own[a] >> _FILTER_BITS][0]))
            linked = unit[i - a] @ unit[j - a].T >= threshold
            if same:
                np.fill_diagonal(linked, False)
            i, j, linked = i[linked.any(axis=1)], j[linked.any(axis=0)], linked[linked.any(axis=1)][:, linked.any(axis=0)]
            if not len(i):
                continue
            fresh = linked & ~_met_before([flat[ends[k] : ends[k + 1]] for k in i], [flat[ends[k] : ends[k + 1]] for k in j], own[a])
            left, right = _roots(linked, name[i], name[j])
            nodes += [name[i]] if same else [name[i], name[j]]
            roots += [left] if same else [left, right]
            counts += [fresh @ copies[j]] if same else [fresh @ copies[j], copies[i] @ fresh]
        if not nodes:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        found, back = np.unique(np.stack([np.concatenate(nodes), np.concatenate(roots)]), axis=1, return_inverse=True)
        return pa.table({"a": found[0], "b": found[1], "n": np.bincount(back.ravel(), np.concatenate(counts), found.shape[1]).astype(np.int64)})

    ship(spark)
    blocks = met_rows.groupBy(F.pmod(F.xxhash64("filter", "low", "high"), F.lit(shards)).alias("shard"))
    found = materialise(blocks.applyInArrow(verify, "a long, b long, n long"))
    counts = found.groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("linked"))
    classes = components(materialise(found.where("a != b").select("a", "b").distinct())).withColumnRenamed("node", "vec_id")
    joined = ids.drop("v").join(counts, "vec_id", "left").join(classes, "vec_id", "left").withColumn("component", F.coalesce("component", "vec_id"))
    joined = materialise(joined.select("h", "g", "least", "component", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("links")))
    least = joined.groupBy("component").agg(F.min("least").alias("reached"))
    known = joined.join(least, "component").select("h", "g", "links", "reached")
    out = rows.select("own_id", "h", "g").join(known, ["h", "g"], "left")
    component = F.when(F.col("links").isNull(), F.col("own_id")).otherwise(F.col("reached"))
    return out.select(F.col("own_id").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("own_id").eqNullSafe(component).alias("kept"))
