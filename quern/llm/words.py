"""Words of whole texts: maximal runs of bytes other than space and U+0009-U+000D."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

from quern.llm.runtime import binary_array, flat_text

_BLANK = np.zeros(256, np.bool_)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass
class Words:
    """codes: dictionary index of each word; docs: n + 1 offsets of documents in codes; dictionary: distinct words as bytes."""

    codes: np.ndarray
    docs: np.ndarray
    dictionary: pa.Array

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the dictionary."""
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.dictionary.to_pylist()), np.uint64, len(self.dictionary))


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    """Words of each text; `lower` maps A-Z to a-z first. Null counts as empty."""
    data, offsets = flat_text(texts)
    if lower:
        data = _LOWER[data]
    inside = ~_BLANK[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    starts[edges] = inside[edges]
    kept = data[inside]
    begins = np.flatnonzero(starts[inside])
    words = binary_array(kept, np.append(begins, len(kept))).dictionary_encode()
    before = np.concatenate([[0], np.cumsum(starts)])
    return Words(words.indices.to_numpy().astype(np.int64), before[offsets], words.dictionary)
