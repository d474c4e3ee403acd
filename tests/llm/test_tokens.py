"""Encoding, counting and packing against the libraries that own the vocabularies."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from quern.llm import bpe, scanner, transducer
from quern.llm.encoding import encode_documents
from quern.llm.packing import pack_documents
from quern.llm.token_counts import count_tokens

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def ranked():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(1)
    parts = ["a", "b", "the", " ", "  ", "\n", "\t", "'s", "'ll", "'re", "'", "'m", "'x", "1", "23", "!", "?!", "é", "ß", "日本", " ", "　", "😀", "<|endoftext|>", "<|endof", "²", "Ⅷ", "ing", "er", "\r\n", "\x1c", "\x85", "ʼ", "'S"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    texts += ["".join(rng.choice("etaoinshrdlu") for _ in range(40)) for _ in range(300)]
    return [*texts, "a" * 5000 + "b" * 300, "ab" * 3000, " " * 5000 + "x", "".join(rng.choice("abcdefghij") for _ in range(3000)), None, "", "'", " '", "\n's", "x's's", "it's 's"]


def test_pretokens_of_all_code_points(ranked):
    own = bpe.encoder(RANKS)
    texts = [f"x{c}y {c}{c}1{c}" for c in map(chr, [*range(0x3000), *range(0xA000, 0xD800, 7), *range(0xF900, 0x11000), *range(0x1F000, 0x20000, 3)])]
    enc = own.encode(pa.array(texts))
    assert [enc.ids[a:b].tolist() for a, b in zip(enc.tokens[:-1], enc.tokens[1:], strict=True)] == [ranked.encode_ordinary(t) for t in texts]


def test_prefix_scan_is_the_sequential_run():
    rng = np.random.default_rng(0)
    maps = rng.integers(0, 9, (37, 9))
    out = scanner.compose_prefix(maps)
    state = np.arange(9)
    for k in range(37):
        state = maps[k][state]
        assert (out[k] == state).all()


def test_both_vocabularies(library, ranked):
    texts = odd_texts()
    array = pa.array(texts, pa.string())
    for path, wanted in ((JSON, [library.encode(t or "", add_special_tokens=False).ids for t in texts]), (RANKS, [ranked.encode_ordinary(t or "") for t in texts])):
        enc = bpe.encoder(path).encode(array)
        assert [enc.ids[a:b].tolist() for a, b in zip(enc.tokens[:-1], enc.tokens[1:], strict=True)] == wanted


def test_small_caches_change_nothing(library):
    texts = odd_texts()
    own = bpe.Encoder(bpe.from_json(JSON))
    own.cache.limit = 50
    counts = transducer.Counter(bpe.from_json(JSON))
    counts.cache.limit, counts.transducer.max_states = 50, 400
    wanted = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    for a in range(0, len(texts), 100):
        part = pa.array(texts[a : a + 100], pa.string())
        assert np.diff(own.encode(part).tokens).tolist() == wanted[a : a + 100]
        assert counts.count(part).tolist() == wanted[a : a + 100]


def test_long_pretokens_through_composed_count_maps(library):
    rng = random.Random(8)
    own = transducer.Transducer(bpe.from_json(JSON))
    for text in ["x" * 70_001, "ab" * 3000, "".join(rng.choice("etaoinshr") for _ in range(150_000)), "".join(rng.choice("日本語ß") for _ in range(3000)), "a" * 513]:
        raw = np.frombuffer(text.encode(), np.uint8)
        assert own.count_long(raw) == len(library.encode(text, add_special_tokens=False).ids)
        assert own.count(raw, np.array([0, len(raw)]))[0].tolist() == [own.count_long(raw)]


def test_count_maps_compose():
    rng = np.random.default_rng(4)
    full = [{s: (int(rng.integers(5)), int(rng.integers(-2, 9))) for s in rng.choice(5, 3, replace=False).tolist()} for _ in range(13)]
    maps = np.array([[(s, *m[s]) for s in m] for m in full])
    got = transducer.CountMaps(maps[:, :, 0], maps[:, :, 1], maps[:, :, 2]).prefixes()
    for k, s in enumerate(maps[0, :, 0].tolist()):
        state, total = s, 0
        for row, m in enumerate(full):
            if state in m:
                state, total = m[state][0], total + m[state][1]
            else:
                state = -1
            assert got.end[row, k] == state and (state < 0 or got.count[row, k] == total)


def test_cached_bytes_are_bounded():
    cache = bpe.WordCache(limit_bytes=100_000)
    work = lambda data, offsets: (np.zeros(int(offsets[-1]), np.int32), np.diff(offsets))
    for k in range(60):
        words = pa.array([(b"%05d" % (k * 5 + n)) * 2000 for n in range(5)], pa.binary())
        rows = cache.look_up(words, work)
        assert cache.counts[rows].tolist() == [10_000] * 5
        assert cache.bytes < 100_000 + 5 * 50_000 and not cache.at and cache.store.nbytes <= cache.bytes


def test_encode_operator(spark, edge, ranked):
    rows = edge.select("doc_id", "text").collect()
    got = encode_documents(edge, RANKS, ("n_tokens", "ids", "offsets", "decoded", "ids_sha256", "decoded_sha256")).collect()
    assert len(got) == len(rows)
    left = defaultdict(list)
    for r in rows:
        left[r.doc_id].append(r.text or "")
    for g in got:
        text = bytes(g.decoded).decode()
        left[g.doc_id].remove(text)
        ids = ranked.encode_ordinary(text)
        assert g.ids == ids and g.n_tokens == len(ids)
        assert g.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        pieces = [ranked.decode_single_token_bytes(i) for i in ids]
        assert g.offsets == np.cumsum([0, *map(len, pieces)])[:-1].tolist()
    assert not any(left.values())


def test_count_operator(spark, edge, library):
    want = sorted(((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in edge.collect()), key=repr)
    got = count_tokens(edge, JSON, 512).collect()
    assert sorted(((g.doc_id, g.n_bytes, g.n_tokens) for g in got), key=repr) == want
    assert all(g.over_limit == (g.n_tokens > 512) for g in got)


@pytest.mark.parametrize("partitions", [1, 7, 150])
def test_packing(spark, library, partitions):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").repartition(partitions)
    texts = {r.doc_id: r.text for r in docs.collect()}
    pieces = pack_documents(docs, JSON, size=256, end=1).collect()
    ids = {k: [*library.encode(t, add_special_tokens=False).ids, 1] for k, t in texts.items()}
    seen, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.ids == ids[p.doc_id][p.start : p.start + p.length] and p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        seen[p.doc_id].append((p.start, p.length))
        sequences[p.sequence_id].append((p.offset, p.length))
    for k, parts in seen.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[k])
    assert seen.keys() == ids.keys()
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
        padding += 256 - at
    assert padding <= 0.05 * 256 * len(sequences)


def test_packing_edge_cases(spark, edge, library):
    pieces = pack_documents(edge, JSON, end=None).collect()
    want = sorted(len(library.encode(r.text, add_special_tokens=False).ids) for r in edge.collect() if r.text)
    assert sum(p.length for p in pieces) == sum(want)
    assert pack_documents(edge.limit(0), JSON).collect() == []
    assert encode_documents(edge.limit(0), RANKS).collect() == [] == count_tokens(edge.limit(0), JSON).collect()
