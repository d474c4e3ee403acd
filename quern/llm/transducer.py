"""A tokenizer compiled to a deterministic finite-state transducer whose transitions carry emitted-token counts.

Pre-tokens are found by the scanner, whose chunk state maps compose through a parallel prefix scan; a long pre-token is
cut into chunks itself, whose maps from state to state and count compose in the same way. Inside a pre-token the state after a prefix is: the longest suffix that some token begins with and goes on after, and for each place in it from
which such a token may start the last token of the encoding up to there, with its count relative to the present. A byte's transition finds the one token that
ends here and may follow what precedes it, and emits the change of the count (merges make it negative). States are
compiled when first met; many pre-tokens then run in step through the table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

from quern.llm.bpe import Vocabulary, WordCache, atoms_in, from_json, from_ranks, merge_one
from quern.llm.runtime import binary_array, flat_text
from quern.llm.scanner import pretokens


#: Pre-tokens of more bytes are cut into chunks of so many bytes, so many of which are run in step; a chunk's first guess
#: of its start state comes from so many bytes before it.
_LONG, _CHUNK, _LANES, _WARM = 512, 256, 256, 48


@dataclass
class CountMaps:
    """Partial maps, one a row, from start states to (end state, tokens emitted on the way); -1 marks unused entries."""

    start: np.ndarray
    end: np.ndarray
    count: np.ndarray

    def then(self, other: CountMaps) -> CountMaps:
        """Row by row this map and then the other one; undefined where the other has no such start."""
        same = (self.end[:, :, None] == other.start[:, None, :]) & (self.end >= 0)[:, :, None]
        at, met = same.argmax(axis=2), same.any(axis=2)
        end, count = np.take_along_axis(other.end, at, axis=1), np.take_along_axis(other.count, at, axis=1)
        return CountMaps(self.start, np.where(met, end, -1), np.where(met, self.count + count, 0))

    def rows(self, at: slice) -> CountMaps:
        return CountMaps(self.start[at], self.end[at], self.count[at])

    def prefixes(self) -> CountMaps:
        """Inclusive parallel prefix scan: row k becomes rows 0, 1, ..., k one after the other."""
        out, step = self, 1
        while step < len(out.start):
            both = out.rows(slice(None, -step)).then(out.rows(slice(step, None)))
            out = CountMaps(*(np.concatenate([x[:step], y]) for x, y in ((out.start, both.start), (out.end, both.end), (out.count, both.count))))
            step *= 2
        return out


class Transducer:
    """Counts tokens of pre-tokens; the compiled states are dropped when their table is full."""

    def __init__(self, vocabulary: Vocabulary, max_states: int = 64_000):
        self.vocabulary, self.max_states = vocabulary, max_states
        self.ids = vocabulary.byte_ids().tolist()
        self.by_bytes = {t: i for i, t in enumerate(vocabulary.tokens) if t}
        self.starts = {t[:k] for t in self.by_bytes for k in range(len(t))}  # what a token may still grow from
        self.follows: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        """Only the start state: nothing read, no token before."""
        self.states: list[tuple[bytes, tuple[tuple[int, int] | None, ...]]] = [(b"", ((-1, 0),))]
        self.number = {self.states[0]: 0}
        self.next = np.full((1024, 256), -1, np.int32)
        self.emits = np.zeros((1024, 256), np.int8)

    def may_follow(self, a: int, b: int) -> bool:
        """Whether encoding both tokens' text gives exactly these two."""
        if a < 0:
            return True
        known = self.follows.get((a, b))
        if known is None:
            raw = self.vocabulary.tokens[a] + self.vocabulary.tokens[b]
            known = self.follows[a, b] = merge_one([self.ids[x] for x in raw], self.vocabulary.pairs) == [a, b]
        return known

    def compile(self, state: int, byte: int) -> int:
        """Add the transition from a state by a byte."""
        tail, places = self.states[state]  # places[k]: last token and relative count after k bytes of tail; None where no token can begin and go on
        text = tail + bytes([byte])
        for size in range(len(text), 0, -1):  # the longest token that fits is the only one that fits
            token, place = self.by_bytes.get(text[len(text) - size :]), places[len(text) - size]
            if token is not None and place is not None:
                before, count = place
                if self.may_follow(before, token):
                    break
        emitted = count + 1
        seen = (*places, (token, emitted))
        while text and text not in self.starts:
            text = text[1:]
        kept = tuple(x and (x[0], x[1] - emitted) if text[k:] in self.starts else None for k, x in enumerate(seen[len(seen) - len(text) - 1 :]))
        to = self.numbered((text, kept))
        self.next[state, byte], self.emits[state, byte] = to, emitted
        return to

    def numbered(self, key: tuple[bytes, tuple[tuple[int, int] | None, ...]]) -> int:
        """The number of a state, a new one if it is new."""
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
            if to >= len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.emits = np.concatenate([self.emits, np.zeros_like(self.emits)])
        return to

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after one byte each, and the changes of the counts."""
        to = self.next[state, byte]
        missing = np.flatnonzero(to < 0)
        if len(missing):
            for key in np.unique(state[missing].astype(np.int64) * 256 + byte[missing]).tolist():
                self.compile(key >> 8, key & 255)
            to = self.next[state, byte]
        return to, self.emits[state, byte]

    def run(self, data: np.ndarray, at: np.ndarray, stop: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """End states and counts of ranges of bytes, all in step, each from its own state."""
        state, total = state.astype(np.int32), np.zeros(len(at), np.int64)
        for k in range(int((stop - at).max(initial=0))):
            going = np.flatnonzero(at + k < stop)
            state[going], emitted = self.step(state[going], data[at[going] + k])
            total[going] += emitted
        return state, total

    def count_long(self, data: np.ndarray) -> int:
        """The tokens of one long pre-token. Chunks are run from guessed states; then each chunk is run from every end that
        the chunk before it has and it does not know, until the prefix scan of the maps is defined throughout."""
        state, total = self.states[0], 0
        for begin in range(0, len(data), _CHUNK * _LANES):
            if len(self.states) > self.max_states:
                self.reset()
            at = np.arange(begin, min(len(data), begin + _CHUNK * _LANES), _CHUNK)
            stop = np.minimum(at + _CHUNK, len(data))
            guess = self.run(data, np.maximum(at - _WARM, 0), at, np.zeros(len(at), np.int32))[0]
            guess[0] = self.numbered(state)
            asked = [(k, int(g)) for k, g in enumerate(guess)]
            known: list[dict[int, tuple[int, int]]] = [{} for _ in at]
            while asked:
                row, start = np.array(asked).T
                end, count = self.run(data, at[row], stop[row], start)
                for k, a, b, c in zip(row.tolist(), start.tolist(), end.tolist(), count.tolist(), strict=True):
                    known[k][a] = (b, c)
                asked = sorted({(k, e) for k in range(1, len(at)) for e, _ in known[k - 1].values() if e not in known[k]})
            width = max(map(len, known))
            maps = np.array([[(a, *m[a]) for a in m] + [(-1, -1, 0)] * (width - len(m)) for m in known])
            whole = CountMaps(maps[:, :, 0], maps[:, :, 1], maps[:, :, 2]).prefixes()  # the first row's only start is the true one
            total += int(whole.count[-1, 0])
            state = self.states[int(whole.end[-1, 0])]
        return total

    def count(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token counts, ones) of pre-tokens; short ones all run in step, the longest first so that the running ones stay in front."""
        lengths = np.diff(offsets)
        out, long = np.empty(len(lengths), np.int64), lengths > _LONG
        for k in np.flatnonzero(long).tolist():
            out[k] = self.count_long(data[offsets[k] : offsets[k + 1]])
        short = np.flatnonzero(~long)
        order = short[np.argsort(-lengths[short], kind="stable")]
        at, left = offsets[:-1][order], lengths[order]
        state, total = np.zeros(len(order), np.int32), np.zeros(len(order), np.int64)
        step, alive = 0, int((left > 0).sum())
        while alive:
            if len(self.states) > self.max_states:
                self.restart(state[:alive])
            state[:alive], emitted = self.step(state[:alive], data[at[:alive] + step])
            total[:alive] += emitted
            step += 1
            while alive and left[alive - 1] <= step:
                alive = int(np.searchsorted(-left, -step, side="left"))
        out[order] = total
        return out.astype(np.int32), np.ones(len(lengths), np.int64)

    def restart(self, state: np.ndarray) -> None:
        """Forget all states but the start and those in use, which get new numbers in place."""
        used, inverse = np.unique(state, return_inverse=True)
        keys = [self.states[k] for k in used.tolist()]
        self.reset()
        state[:] = np.array([self.numbered(key) for key in keys], np.int32)[inverse]


class Counter:
    """Token counts of whole texts."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.transducer = vocabulary, Transducer(vocabulary)
        self.cache = WordCache(dict.fromkeys(vocabulary.specials, 1))

    def count(self, texts: pa.Array) -> np.ndarray:
        data, offsets = flat_text(texts)
        pieces, before = pretokens(data, offsets, atoms_in(data, offsets, self.vocabulary.specials))
        if len(pieces) < 2:
            return np.zeros(len(texts), np.int64)
        words = binary_array(data, pieces).dictionary_encode()
        rows = self.cache.look_up(words.dictionary, self.transducer.count)
        counts = self.cache.store[self.cache.starts[rows]][words.indices.to_numpy()]
        return np.diff(np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[before])


@cache
def counter(path: str) -> Counter:
    """One counter a file in each Python worker."""
    return Counter(from_json(path) if path.endswith(".json") else from_ranks(path))
