"""Byte-level BPE over pre-tokens: ragged pair merging of all new pre-tokens of a batch at once, behind a bounded cache."""

from __future__ import annotations

import base64
import heapq
import json
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

from quern.llm.runtime import binary_array, flat_text, ragged
from quern.llm.scanner import pretokens

_NEVER = np.int32(2**31 - 1)
#: Pre-tokens longer than this many bytes are merged one by one with a heap.
_LONG = 256
#: The pair table's hash: a multiplier and slots - 1.
_MIX, _SLOTS = np.int64(0x1E3779B97F4A7C15), np.int64((1 << 21) - 1)


@dataclass(frozen=True)
class Vocabulary:
    """tokens: bytes by id. pairs: (left id, right id) -> (rank, merged id). specials: text -> id, found before splitting."""

    tokens: list[bytes]
    pairs: dict[tuple[int, int], tuple[int, int]]
    specials: dict[bytes, int]

    def byte_ids(self) -> np.ndarray:
        by_bytes = {t: i for i, t in enumerate(self.tokens) if len(t) == 1}
        return np.array([by_bytes[bytes([b])] for b in range(256)], np.int32)


@cache
def from_ranks(path: str) -> Vocabulary:
    """A rank file: any two neighbours whose concatenation is a token may merge, by the rank of that token."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tokens = [b""] * (max(ranks.values()) + 1)
    for t, r in ranks.items():
        tokens[r] = t
    pairs = {(ranks[t[:k]], ranks[t[k:]]): (r, r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
    return Vocabulary(tokens, pairs, {})


@cache
def from_json(path: str) -> Vocabulary:
    """A tokenizer file with a byte-level BPE model: only its listed merges apply, in their order."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves; the others are moved above 255 in order
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    raw = lambda s: bytes(byte_of[c] for c in s)
    vocab = spec["model"]["vocab"]
    tokens = [b""] * (max(vocab.values()) + 1)
    for t, i in vocab.items():
        if all(c in byte_of for c in t):
            tokens[i] = raw(t)
    pairs = {}
    for rank, merge in enumerate(spec["model"]["merges"]):
        a, b = merge if isinstance(merge, list) else merge.split(" ")
        pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
    return Vocabulary(tokens, pairs, {t["content"].encode(): t["id"] for t in spec["added_tokens"]})


def merge_one(ids: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Pair merging of one pre-token in O(n log n): lowest rank first, leftmost first among equals."""
    n = len(ids)
    ids, after, before, alive = list(ids), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(p[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (p := pairs.get((ids[i], ids[i + 1])))]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
            continue
        ids[i], alive[j], after[i] = pairs[a, b][1], False, after[j]
        if after[j] < n:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < n and (p := pairs.get((ids[k], ids[after[k]]))):
                heapq.heappush(heap, (p[0], k, ids[k], ids[after[k]]))
    return [x for x, ok in zip(ids, alive, strict=True) if ok]


class Merger:
    """Pair merging of many pre-tokens in step."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.byte_ids = vocabulary.byte_ids()
        self.size = len(vocabulary.tokens)
        items = sorted((a * self.size + b, rank, merged) for (a, b), (rank, merged) in vocabulary.pairs.items())
        items.append((2**62, int(_NEVER), 0))  # the place of all pairs that don't merge
        self.keys, ranks, merged = (np.array(x, np.int64) for x in zip(*items, strict=True))
        self.ranks, self.merged = ranks.astype(np.int32), merged.astype(np.int32)
        slot = (self.keys[:-1] * _MIX >> 40) & _SLOTS
        self.slots = np.full(_SLOTS + 1, len(self.keys) - 1, np.int32)
        self.slots[slot] = np.arange(len(slot))
        self.crowded = np.bincount(slot, minlength=_SLOTS + 1) > 1
        self.first = self._find(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256)).reshape(256, 256)

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places in the pair table; its length where there is no such pair."""
        key = a.astype(np.int64) * self.size + b
        slot = (key * _MIX >> 40) & _SLOTS
        at = self.slots[slot]
        wrong = np.flatnonzero(self.keys[at] != key)
        again = wrong[self.crowded[slot[wrong]]]
        at[wrong] = len(self.keys) - 1
        if len(again):
            place = np.searchsorted(self.keys, key[again])
            at[again] = np.where(self.keys[place] == key[again], place, len(self.keys) - 1)
        return at

    def merge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pre-tokens in order, and how many each has."""
        lengths = np.diff(offsets)
        counts, found = np.zeros(len(lengths), np.int64), []
        for k in np.flatnonzero(lengths > _LONG):
            ids = merge_one(self.byte_ids[data[offsets[k] : offsets[k + 1]]].tolist(), self.vocabulary.pairs)
            found.append((np.full(len(ids), k), np.array(ids, np.int32)))
        short = np.flatnonzero((lengths <= _LONG) & (lengths > 0))
        n = lengths[short]
        raw = data[ragged(offsets[short], n)]
        ids, word = self.byte_ids[raw], np.repeat(short, n)
        none = np.int32(len(self.keys) - 1)
        pair = np.full(len(ids), none, np.int32)
        pair[:-1] = self.first[raw[:-1], raw[1:]]
        last = np.zeros(len(ids), np.bool_)
        last[np.cumsum(n) - 1] = True
        pair[last] = none
        while len(ids):
            starts = np.flatnonzero(np.concatenate([[True], last[:-1]]))
            sizes = np.diff(np.append(starts, len(ids)))
            rank = self.ranks[pair]
            best = np.minimum.reduceat(rank, starts)
            going = best != _NEVER
            if not going.all():
                over = np.repeat(~going, sizes)
                found.append((word[over], ids[over]))
                ids, word, pair, last, rank = (x[~over] for x in (ids, word, pair, last, rank))
                if not len(ids):
                    break
                sizes, best = sizes[going], best[going]
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            fresh = np.concatenate([[True], np.diff(at) != 1])  # of overlapping equal pairs every other one merges, from the left
            group = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - group) % 2 == 0]
            ids[at], last[at] = self.merged[pair[at]], last[at + 1]
            keep = np.ones(len(ids), np.bool_)
            keep[at + 1] = False
            at = (np.cumsum(keep) - 1)[at]
            ids, word, pair, last = ids[keep], word[keep], pair[keep], last[keep]
            touched = np.concatenate([at, at[(at > 0)] - 1])
            touched = touched[~last[touched]]
            pair[at] = none
            pair[touched] = self._find(ids[touched], ids[touched + 1])
        if not found:
            return np.zeros(0, np.int32), counts
        word, ids = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
        counts += np.bincount(word, minlength=len(counts))
        return ids[np.argsort(word, kind="stable")], counts


@dataclass
class Encoded:
    """ids of all documents in order; tokens: n + 1 offsets of documents in ids; pieces, piece_tokens: byte offset and token count of each pre-token."""

    ids: np.ndarray
    tokens: np.ndarray
    pieces: np.ndarray
    piece_tokens: np.ndarray


class WordCache:
    """Remembers the outcome of short pre-tokens; emptied when it holds too many words or bytes, so a worker's memory stays bounded."""

    #: Longer pre-tokens are worked out each time.
    LONGEST = 64

    def __init__(self, fixed: dict[bytes, int] | None = None, limit: int = 700_000, limit_bytes: int = 64 << 20):
        self.limit, self.limit_bytes, self.fixed = limit, limit_bytes, fixed or {}
        self.reset()

    def reset(self) -> None:
        """Only the fixed one-value pre-tokens remain."""
        self.at, self.bytes = {w: k for k, w in enumerate(self.fixed)}, 0
        self.starts, self.counts, self.store = np.arange(len(self.fixed)), np.ones(len(self.fixed), np.int64), np.array(list(self.fixed.values()), np.int32)

    def look_up(self, dictionary: pa.Array, work) -> np.ndarray:
        """Rows of starts and counts for each pre-token of the dictionary; `work` gives (values, counts) of unknown ones. The
        rows hold until the next call."""
        words = dictionary.to_pylist()
        if len(self.at) + len(words) > self.limit or self.bytes > self.limit_bytes:
            self.reset()
        rows = np.fromiter(map(self.at.get, words, [-1] * len(words)), np.int64, len(words))
        new = np.flatnonzero(rows < 0)
        if len(new):
            data, offsets = flat_text(dictionary.take(pa.array(new)))
            values, counts = work(data, offsets)
            base = len(self.starts)
            rows[new] = np.arange(base, base + len(new))
            self.starts = np.concatenate([self.starts, len(self.store) + np.cumsum(counts) - counts])
            self.counts = np.concatenate([self.counts, counts])
            self.store = np.concatenate([self.store, values])
            short = [k for k in new.tolist() if len(words[k]) <= self.LONGEST]
            self.at.update(zip((words[k] for k in short), rows[short].tolist(), strict=True))
            self.bytes += sum(len(words[k]) for k in short) + values.nbytes + 16 * len(new)
        return rows


def atoms_in(data: np.ndarray, offsets: np.ndarray, specials: dict[bytes, int]) -> np.ndarray | None:
    """[start, end) of special strings inside documents, in order."""
    if not specials:
        return None
    raw, found = data.tobytes(), []
    for text in specials:
        at = raw.find(text)
        while at >= 0:
            if offsets[np.searchsorted(offsets, at, side="right")] >= at + len(text):
                found.append((at, at + len(text)))
                at = raw.find(text, at + len(text))
            else:
                at = raw.find(text, at + 1)
    return np.array(sorted(found), np.int64).reshape(-1, 2) if found else None


class Encoder:
    """Encodes batches of whole texts; special strings become their ids, everything else goes through the pre-tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.merger, self.cache = vocabulary, Merger(vocabulary), WordCache(vocabulary.specials)
        self.token_bytes = pa.array(vocabulary.tokens, pa.binary())

    def encode(self, texts: pa.Array) -> Encoded:
        data, offsets = flat_text(texts)
        pieces, before = pretokens(data, offsets, atoms_in(data, offsets, self.vocabulary.specials))
        if len(pieces) < 2:
            return Encoded(np.zeros(0, np.int32), np.zeros(len(offsets), np.int64), pieces, np.zeros(0, np.int64))
        words = binary_array(data, pieces).dictionary_encode()
        rows = self.cache.look_up(words.dictionary, self.merger.merge)[words.indices.to_numpy()]
        counts = self.cache.counts[rows]
        ids = self.cache.store[ragged(self.cache.starts[rows], counts)]
        return Encoded(ids, np.concatenate([[0], np.cumsum(counts)])[before], pieces, counts)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids in order, and len(ids) + 1 byte offsets."""
        return flat_text(self.token_bytes.take(pa.array(ids)))


@cache
def encoder(path: str) -> Encoder:
    """One encoder a file in each Python worker."""
    return Encoder(from_json(path) if path.endswith(".json") else from_ranks(path))
