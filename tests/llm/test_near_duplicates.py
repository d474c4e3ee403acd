"""Near-duplicate texts and vectors against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from quern.llm.cap_filters import link_vectors
from quern.llm.graph import components
from quern.llm.minhash import Sampler, near_duplicates, similarity, weigh
from quern.llm.shingles import SKETCH, frequencies, idf, shingles


def plain_links(texts, width=5, threshold=0.8):
    """All pairs by weighted Jaccard similarity, from counted word tuples and exact document frequencies."""
    sets = []
    for t in texts:
        w = t.split()
        sets.append(Counter(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else Counter())
    df = Counter(x for s in sets for x in s)
    weight = {x: float(idf(np.array([n / len(texts)]))[0]) for x, n in df.items()}
    sums = [sum(weight[x] * n for x, n in s.items()) for s in sets]
    links = []
    for a in range(len(texts)):
        for b in range(a):
            common = sum(weight[x] * min(n, sets[b][x]) for x, n in sets[a].items() if x in sets[b])
            if common and common >= threshold * (sums[a] + sums[b] - common):
                links.append((a, b))
    return links


def closure(n, links):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(rng.randint(50, 99), rng.randint(50, 99)) for _ in range(30)]
    links = [(a, b) for a, b in links if a != b]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    want = closure(100, links)
    assert got == {k: want[k] for k in {x for p in links for x in p}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_shingles_of_short_texts():
    texts = ["a b c d e f", "a b c", "a b c d", "", None, "a b c d e f a b c d e"]
    sets = shingles(pa.array(texts))
    assert np.diff(sets.docs).tolist() == [2, 1, 1, 0, 0, 6]
    assert sets.tf[sets.docs[5] :].sum() == 7
    assert similarity(shingles(pa.array(["a b c", "a b c", ""])), shingles(pa.array(["a b c", "a b d", ""])), np.ones(SKETCH)).tolist() == [1, 0, 0]


def test_samples_agree_as_often_as_sets_are_similar():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(500)]
    base = [rng.choice(words) for _ in range(400)]
    other = list(base)
    for k in rng.sample(range(400), 8):
        other[k] = "changed" + str(k)
    sets = shingles(pa.array([" ".join(base), " ".join(other)]))
    idfs = idf(np.full(SKETCH, 0.01))
    samples = Sampler(600).sample(sets, weigh(sets, idfs))
    true = similarity(shingles(pa.array([" ".join(base)])), shingles(pa.array([" ".join(other)])), idfs)[0]
    assert abs((samples[0] == samples[1]).mean() - true) < 0.06


def test_sketch_counts_documents(spark):
    df = spark.createDataFrame([(k, "one two three four five" + (" six" if k % 4 == 0 else "")) for k in range(40)], "doc_id long, text string").repartition(3)
    found = frequencies(df)
    key = shingles(pa.array(["one two three four five"])).hash[0] & np.uint64(SKETCH - 1)
    assert found[int(key)] == 1.0 and np.isclose(found.sum(), 1.25)
    weights = idf(np.array([1.0, 0.01, 1e-9]))
    assert weights[0] == 1 and weights[0] < weights[1] < weights[2] <= 1.25


def test_texts_against_brute_force(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(60, 200))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            copy = list(base)
            for k in rng.sample(range(len(base)), rng.randint(0, max(1, len(base) // 40))):
                copy[k] = rng.choice(words)
            texts.append(" ".join(copy))
    hub = [rng.choice(words) for _ in range(300)]  # one large group around a text
    for k in range(60):
        copy = list(hub)
        for at in rng.sample(range(300), 0 if k == 30 else 3):
            copy[at] = rng.choice(words)
        texts.append(" ".join(copy))
    texts += [texts[0], texts[0], "", "", "a b"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts = [texts[k] for k in order]
    got = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()}
    want = closure(len(texts), plain_links(texts))
    assert len(got) == len(texts)
    assert [got[k].class_id for k in range(len(texts))] == want
    assert all(r.kept == (r.doc_id == r.class_id) for r in got.values())


def test_large_buckets_have_all_pairs_compared(spark):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(3000)]
    base, texts = [rng.choice(words) for _ in range(200)], []
    for _ in range(300):
        copy = list(base)
        for k in rng.sample(range(200), 3):
            copy[k] = rng.choice(words)
        texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.class_id for r in near_duplicates(df).collect()}
    links = plain_links(texts)
    want = closure(300, links)
    alike = [(a, b) for a, b in links if got[a] == got[b]]
    assert len(alike) >= 0.99 * len(links)
    assert all(want[k] == want[c] for k, c in got.items())
    assert len(set(got.values())) <= len(set(want)) + 2


def test_texts_edge_cases(spark, edge):
    got = near_duplicates(edge).collect()
    assert len(got) == edge.count()
    by = {r.doc_id: r.class_id for r in got}
    assert by[6] == by[7] == by[8] == 6 and by[9] == by[10] == 9
    assert [by[k] for k in (1, 2, 3, 4, 5, 11, 12, 13, 14)] == [1, 2, 3, 4, 5, 11, 12, 13, 14]
    assert by[None] is None and sum(r.doc_id == 8 for r in got) == 2
    assert near_duplicates(edge.limit(0)).collect() == []


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(100):
        turned = rng.normal(size=48)
        turned -= turned @ x[k] * x[k]
        c = rng.uniform(0.85, 0.99)
        x[1000 + k] = c * x[k] + np.sqrt(1 - c * c) * turned / np.linalg.norm(turned)
    x[1100:1400] = x[0] + 0.01 * rng.normal(size=(300, 48))
    x[1400:1420] = x[1]
    x *= rng.uniform(0.1, 1000, (1500, 1))
    rows = [(k, v.tolist(), k % 3) for k, v in enumerate(x)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    got = {r.vec_id: r for r in link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)).collect()}
    counts = np.array([got[k].n_links for k in range(1500)])
    assert (counts <= linked.sum(axis=1)).all() and counts.sum() >= 0.995 * linked.sum()
    want = closure(1500, list(zip(*np.nonzero(linked), strict=True)))
    assert np.mean([got[k].component_id == want[k] for k in range(1500)]) > 0.995


def test_large_buckets_are_cut_into_sides(spark, monkeypatch):
    from quern.llm import cap_filters

    monkeypatch.setattr(cap_filters, "SIDE", 16)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(1, 32)) + 0.02 * rng.normal(size=(120, 32)), rng.normal(size=(100, 32))])
    got = {r.vec_id: r for r in link_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()}
    assert [got[k].n_links for k in range(120)] == [119] * 120 and {got[k].component_id for k in range(120)} == {0}
    assert all(got[k].n_links == 0 and got[k].kept for k in range(120, 220))


def test_vectors_of_every_length_are_linked(spark, monkeypatch):
    from quern.llm import cap_filters

    monkeypatch.setattr(cap_filters, "SIDE", 32)
    rng = np.random.default_rng(9)
    rows = []
    for d, n in ((16, 60), (24, 40), (5, 10)):  # each vector twice
        x = rng.normal(size=(n // 2, d))
        rows += [v.tolist() for v in x for _ in range(2)]
    got = {r.vec_id: r for r in link_vectors(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>").repartition(3)).collect()}
    units = [np.array(v) / np.linalg.norm(v) for v in rows]
    links = [(a, b) for a in range(110) for b in range(110) if a != b and len(rows[a]) == len(rows[b]) and units[a] @ units[b] >= 0.9]
    assert [got[k].component_id for k in range(110)] == closure(110, links)
    assert all(got[k].n_links >= 1 for k in range(110))


def test_vector_edge_cases(spark):
    rows = [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1.0, 2.0, 3.0]), (8, []), (9, [float("inf"), 1.0]), (2, [2.0, 4.0]), (None, [1.0, 2.0]), (10, [-1.0, -2.0])]
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in link_vectors(spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<double>, filter int, v string")).collect())
    assert got == Counter({(1, 3, 1, True): 1, (2, 3, 1, False): 2, (None, 3, 1, False): 1} | {(k, 0, k, True): 1 for k in (3, 4, 5, 6, 7, 8, 9, 10)})
    twins = link_vectors(spark.createDataFrame([(5, [1.0, 0.0]), (5, [0.0, 1.0]), (None, [3.0, -1e-9]), (None, [-1.0, 0.0])], "vec_id long, embedding array<double>")).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in twins) == Counter([(5, 1, 5, True), (5, 0, 5, True), (None, 1, 5, False), (None, 0, None, True)])
    assert link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    assert len(link_vectors(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect()) == 1


def test_scratch_is_cleared(spark):
    from quern.llm import runtime

    df = runtime.materialise(spark.range(3))
    assert df.count() == 3 and runtime._written
    folder = runtime._written[-1].removeprefix("file://")
    runtime.clear_scratch(spark)
    import os

    assert not os.path.exists(folder) and not runtime._written
