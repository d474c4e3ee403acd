"""Elias-Fano sequences in compact memory-mapped levels, and an n-gram trie made of them."""

from __future__ import annotations

import tempfile

import numpy as np

#: Places looked up at once; bounds what a query gathers.
_STEP = 1 << 17


def _neighbours(at: np.ndarray, look_up) -> tuple[np.ndarray, np.ndarray]:
    """look_up(x) and look_up(x + 1) for each x of `at`; runs of equal and neighbouring numbers, as in a sorted batch, are looked up once."""
    heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    own = at[heads]
    first = look_up(own)
    second = np.empty_like(first)
    second[:-1] = first[1:]
    alone = np.flatnonzero(np.append(own[1:] != own[:-1] + 1, True))
    second[alone] = look_up(own[alone] + 1)
    sizes = np.diff(np.append(heads, len(at)))
    return np.repeat(first, sizes), np.repeat(second, sizes)


class LevelFile:
    """The file that all levels of a trie are written to and mapped from. It has no name, so it goes with its last mapping, also if the task dies."""

    def __init__(self):
        self.file = tempfile.TemporaryFile()

    def put(self, data: np.ndarray) -> np.ndarray:
        """Append an array and map it; an empty one needs no file."""
        if not data.size:
            return data
        at = -(-self.file.seek(0, 2) // 64) * 64
        self.file.seek(at)
        self.file.write(np.ascontiguousarray(data).data)
        self.file.flush()
        return np.memmap(self.file, data.dtype, "r", at, data.shape)


class Bits:
    """A bit vector with select of ones and zeros; all it holds besides is the number of ones before each word of 64 bits."""

    def __init__(self, ones: np.ndarray, size: int, file: LevelFile):
        bits = np.zeros(-(-max(1, size) // 64) * 64, np.bool_)
        bits[ones] = True
        words = np.packbits(bits, bitorder="little").view("<u8")
        self.words = file.put(words)
        self.before = file.put(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]).astype(np.uint32))

    def select(self, k: np.ndarray, bit: int = 1) -> np.ndarray:
        """The position of the k-th one (or zero), counted from 0; it must be there."""
        before = self.before.astype(np.int64)
        if not bit:
            before = np.arange(len(before)) * 64 - before
        out = np.empty(len(k), np.int64)
        for at in range(0, len(k), _STEP):
            want = k[at : at + _STEP]
            which = np.searchsorted(before, want, side="right") - 1
            rest = (want - before[which]).astype(np.uint8)
            word, place = np.asarray(self.words)[which], which * 64
            if not bit:
                word = ~word
            for half in (32, 16, 8, 4, 2, 1):
                low = word & np.uint64((1 << half) - 1)
                count = np.bitwise_count(low)
                over = rest >= count
                rest -= count * over
                place += over * half
                word = np.where(over, word >> np.uint64(half), low)
            out[at : at + _STEP] = place
        return out


class EliasFano:
    """A sorted sequence of unsigned numbers: low bits packed, high bits as the gaps between the ones of a bit vector."""

    def __init__(self, values: np.ndarray, universe: int, file: LevelFile):
        """universe: no value is larger."""
        self.n = len(values)
        self.low_bits = max(0, int(universe // max(1, self.n)).bit_length() - 1)
        self.mask = np.uint64((1 << self.low_bits) - 1)
        self.low = file.put(self._pack(values & self.mask))
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        self.buckets = int(universe >> self.low_bits) + 1
        self.high = Bits(high + np.arange(self.n), self.n + self.buckets, file)

    def _pack(self, low: np.ndarray) -> np.ndarray:
        bits = self.low_bits
        if not bits or not len(low):
            return np.zeros(0, np.uint64)
        parts = []
        for at in range(0, len(low), 1 << 18):  # so many values end at a byte whatever their bits
            each = low[at : at + (1 << 18)].astype("<u8").view(np.uint8).reshape(-1, 8)
            parts.append(np.packbits(np.unpackbits(each, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little"))
        raw = np.concatenate([*parts, np.zeros(16, np.uint8)])
        return raw[: len(raw) // 8 * 8].view("<u8")

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        bit, low = at * self.low_bits, np.asarray(self.low)
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        first = low[word] >> shift
        rest = (low[word + 1] << np.uint64(1)) << (np.uint64(63) - shift)
        return (first | rest) & self.mask

    def access(self, at: np.ndarray) -> np.ndarray:
        """The values at places of the sequence."""
        high = self.high.select(at) - at
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | self._low(at)

    def find(self, keys: np.ndarray, start: np.ndarray | int = 0, stop: np.ndarray | None = None) -> np.ndarray:
        """The place of each key among the places start..stop-1, or -1: a successor search from the gap of the key's high bits."""
        found = np.full(len(keys), -1, np.int64)
        high = (keys >> np.uint64(self.low_bits)).astype(np.int64)
        ask = np.flatnonzero((high >= 0) & (high < self.buckets)) if self.n else np.zeros(0, np.int64)
        if not len(ask):
            return found
        key, high = keys[ask] & self.mask, high[ask]
        left, right = _neighbours(high, lambda h: np.where(h > 0, self.high.select(np.maximum(h, 1) - 1, 0) - h + 1, 0))
        left = np.maximum(left, start if np.isscalar(start) else start[ask])
        end = right = np.minimum(right, self.n if stop is None else stop[ask])
        left, right = left.copy(), right.copy()
        going = np.flatnonzero(left < right)
        while len(going):
            middle = (left[going] + right[going]) >> 1
            less = self._low(middle) < key[going]
            left[going[less]] = middle[less] + 1
            right[going[~less]] = middle[~less]
            going = going[left[going] < right[going]]
        there = np.flatnonzero(left < end)
        hit = there[self._low(left[there]) == key[there]]
        found[ask[hit]] = left[hit]
        return found


class Level:
    """Children of the nodes of the level above: monotone pointers say where the children of each node begin, and the
    children's fingerprints are made monotone by the number of their parent. A child is found by a successor search
    inside its parent's range."""

    def __init__(self, file: LevelFile, pointers: np.ndarray, fingers: np.ndarray, bits: int):
        """pointers: one more than parents; fingers: of so many bits, sorted within each parent."""
        self.bits, parents = np.uint64(bits), len(pointers) - 1
        self.pointers = EliasFano(pointers.astype(np.uint64), max(1, len(fingers)), file)
        owner = np.repeat(np.arange(parents, dtype=np.uint64), np.diff(pointers))
        self.children = EliasFano((owner << self.bits) | fingers.astype(np.uint64), max(1, parents) << bits, file)

    def find(self, parent: np.ndarray, fingers: np.ndarray) -> np.ndarray:
        """Numbers of children, -1 where there is none or no parent."""
        out = np.full(len(parent), -1, np.int64)
        known = np.flatnonzero(parent >= 0)
        if len(known) and self.children.n:
            own = parent[known]
            start, stop = _neighbours(own, lambda at: self.pointers.access(at).astype(np.int64))
            out[known] = self.children.find((own.astype(np.uint64) << self.bits) | fingers[known].astype(np.uint64), start, stop)
        return out


class Trie:
    """Word hashes with counts, their successors (pairs), and theirs (triples). Pairs and triples hold quantised
    log10 values in units of STEP below 0."""

    STEP, NONE = 1 / 20, 255

    def __init__(self, words: np.ndarray, counts: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, int], triples: tuple[np.ndarray, np.ndarray, int], **values: np.ndarray):
        """pairs, triples: (pointers, fingers, bits); values: log10 values of pairs or triples, by name."""
        file = LevelFile()
        self.words = EliasFano(words, (1 << 64) - 1, file)
        self.counts = file.put(counts.astype(np.int64))
        self.pairs, self.triples = Level(file, *pairs), Level(file, *triples)
        self.codes = {name: file.put(self.quantised(v)) for name, v in values.items()}

    @classmethod
    def quantised(cls, log_p: np.ndarray) -> np.ndarray:
        return np.clip(np.round(-log_p / cls.STEP), 0, cls.NONE - 1).astype(np.uint8)

    @classmethod
    def value(cls, codes: np.ndarray) -> np.ndarray:
        """What codes stand for; 0 for NONE."""
        return np.append(10.0 ** (-cls.STEP * np.arange(cls.NONE)), 0.0)[codes]

    def read(self, name: str, at: np.ndarray, missing: int) -> np.ndarray:
        """Codes at places, `missing` at -1."""
        out = np.full(len(at), missing, np.uint8)
        known = np.flatnonzero(at >= 0)
        out[known] = np.asarray(self.codes[name])[at[known]]
        return out
