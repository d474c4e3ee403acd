"""Trigram language-model scores from Elias-Fano tries, one for each range of n-grams.

1. Word counts: distinct words of each task with their counts go to a shard by hash. What comes back are totals and the
   words that hold so large a share of all tokens that their n-grams are dealt over several tries; with fewer than
   4 of them for each trie and 2^20 in all, their number is bounded.
2. Requests: each slice of texts sorts its distinct n-grams by the words' hashes, as a small trie of its own, and cuts it
   at the bounds of the ranges. A range gets for each slice the words, pairs and triples that begin in it, with the
   triples' occurrences in training texts (those of pairs and words are sums over what follows, as every text ends with
   two marks).
3. Each range adds up the training counts, builds the trie in memory-mapped levels, looks up every n-gram that was asked
   for, and replies to each slice in the same order: each word's own count, and quantised terms of pairs and triples.
4. Each slice joins the replies in the order of ranges and adds up its texts' scores.

P1(w) = (c(w) + add) / (N + add (V + 1)), P2(w|b) = c(bw) / (c(b) + mu) + mu / (c(b) + mu) P1(w) and
P3(w|ab) = c(abw) / (c(ab) + nu) + nu / (c(ab) + nu) P2(w|b); the first term of P2 and both factors of P3 are quantised.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.elias_fano import Trie
from quern.llm.runtime import arrow_map, crc32_mod, materialise
from quern.llm.shingles import few
from quern.llm.words import split_words

#: Marks before and after the words of a text.
START, END, PAD = (np.uint64(x) for x in (0x5354415254000001, 0x454E440000000003, 0x5041440000000005))
#: Bits of a word's fingerprint as the second of a pair and the third of a triple.
_PAIR_BITS, _TRIPLE_BITS = 32, 24
#: Distinct words that a task gathers before it sends them on; training tokens for each trie; words that are dealt over several tries, at most.
_GATHER, _TRIE_TOKENS, _DEALT = 1_500_000, 1_000_000, 1 << 20


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers as the planes of their bytes; planes of zeros take next to nothing."""
    out, squeeze = io.BytesIO(), zstandard.ZstdCompressor(1).compress
    for a in arrays:
        raw = squeeze(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()) if len(a) else b""
        out.write(np.array([len(a), a.dtype.itemsize, len(raw)], np.int64).tobytes() + raw)
    return out.getvalue()


def _unpack(raw: bytes, *types: str) -> list[np.ndarray]:
    out, at, whole = [], 0, zstandard.ZstdDecompressor().decompress
    for t in types:
        n, size, length = np.frombuffer(raw, np.int64, 3, at).tolist()
        data = np.frombuffer(whole(raw[at + 24 : at + 24 + length], n * size) if n else b"", np.uint8)
        out.append(np.ascontiguousarray(data.reshape(size, n).T).view(t).reshape(n))
        at += 24 + length
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences of neighbours, which np.cumsum undoes."""
    return np.diff(x, prepend=np.zeros(1, x.dtype))


@dataclass
class Corpus:
    """Totals of the training texts and the ranges of n-grams. `tries` ranges of equal width divide the hashes of first
    words; each of the sorted `dealt` words has `parts` ranges of its own, by the second word."""

    dealt: np.ndarray
    counts: np.ndarray
    parts: np.ndarray
    train_docs: int
    tokens: int
    distinct: int
    tries: int

    def dealt_place(self, words: np.ndarray) -> np.ndarray:
        """Places in `dealt`, -1 for other words."""
        at = np.minimum(np.searchsorted(self.dealt, words), max(0, len(self.dealt) - 1))
        return np.where(self.dealt[at] == words, at, -1) if len(self.dealt) else np.full(len(words), -1)

    def range(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The range of n-grams by their first two words; it never falls from a smaller (first, second) to a larger one."""
        before = np.concatenate([[0], np.cumsum(self.parts)]).astype(np.int64)
        at, own = np.searchsorted(self.dealt, first), self.dealt_place(first)
        part = np.zeros(len(first), np.int64)
        hot = np.flatnonzero(own >= 0)
        part[hot] = ((second[hot] >> np.uint64(32)) * self.parts[own[hot]].astype(np.uint64)) >> np.uint64(32)
        return (((first >> np.uint64(32)) * np.uint64(self.tries)) >> np.uint64(32)).astype(np.int64) + before[at] + part

    def known_counts(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The same counts, but of the whole corpus where a word's n-grams are dealt over several tries."""
        own = self.dealt_place(words)
        return np.where(own >= 0, self.counts[own] if len(self.counts) else 0, counts)


def _training(ids: pa.Array, folds: int) -> np.ndarray:
    return crc32_mod(ids, folds) != 0


def _count_words(docs: DataFrame, folds: int) -> Corpus:
    settings = docs.sparkSession.conf
    shards = min(1 << 16, int(settings.get("spark.sql.shuffle.partitions")))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_words, held_counts, held, train_docs = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held_words, held_counts, held, train_docs
            words, back = np.unique(np.concatenate([*held_words, np.zeros(0, np.uint64)]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([*held_counts, np.zeros(0)]), len(words)).astype(np.uint32)
            to = ((words >> np.uint64(48)).astype(np.int64) * shards) >> 16
            cuts = np.searchsorted(to, np.arange(shards + 1))
            rows = [(k, int(train_docs) if k == 0 else 0, _pack(_steps(words[a:b]), counts[a:b])) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a or k == 0]
            held_words, held_counts, held, train_docs = [], [], 0, 0
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["shard", "docs", "blob"])

        for batch in few(batches):
            train = _training(batch.column("doc_id"), folds)
            words = split_words(batch.column("text"), lower=True)
            counts = np.bincount(words.codes[np.repeat(train, np.diff(words.docs))], minlength=len(words.dictionary))
            held_words.append(words.hashes()[counts > 0])
            held_counts.append(counts[counts > 0])
            held, train_docs = held + len(held_words[-1]), train_docs + train.sum()
            if held > _GATHER:
                yield flush()
        if train_docs or held:
            yield flush()

    def total(table: pa.Table) -> pa.Table:
        parts = [_unpack(x, "u8", "u4") for x in table["blob"].to_pylist()]
        words, back = np.unique(np.concatenate([np.cumsum(p[0]) for p in parts]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([p[1] for p in parts]), len(words)).astype(np.int64)
        many = counts * _DEALT >= counts.sum()  # at least all that have so large a share of the whole
        n = int(many.sum())
        return pa.table(
            {
                "word": pa.array([*words[many].view(np.int64).tolist(), None], pa.int64()),
                "n": np.append(counts[many], counts.sum()),
                "distinct": np.append(np.zeros(n, np.int64), len(words)),
                "docs": np.append(np.zeros(n, np.int64), sum(table["docs"].to_pylist())),
            }
        )

    found = materialise(arrow_map(docs, partial, "shard int, docs long, blob binary").groupBy("shard").applyInArrow(total, "word long, n long, distinct long, docs long"))
    sums = found.where("word IS NULL").agg(F.sum("n"), F.sum("distinct"), F.sum("docs")).first()
    tokens, distinct, train_docs = (x or 0 for x in sums)
    tokens, distinct = tokens + train_docs, distinct + (train_docs > 0)
    tries = max(2 * shards, -(-tokens // _TRIE_TOKENS)) if tokens >= _TRIE_TOKENS // 8 else 4
    share = min(4 * tries, _DEALT)  # a word with at least one part in so many is dealt; there are at most so many
    words = found.where(f"word IS NOT NULL AND n * {share} >= {tokens}").select("word", "n").toArrow()
    dealt, counts = words["word"].to_numpy().view(np.uint64), words["n"].to_numpy()
    if train_docs * share >= tokens > 0:
        dealt, counts = np.append(dealt, START), np.append(counts, train_docs)
    order = np.argsort(dealt)
    dealt, counts = dealt[order].astype(np.uint64), counts[order].astype(np.int64)
    return Corpus(dealt, counts, np.maximum(1, -(-counts * 4 * tries // max(1, tokens))).astype(np.int64), train_docs, tokens, distinct, tries)


@dataclass
class Grams:
    """Distinct n-grams of a slice: `pairs` and `triples` by their words' codes, `pair` and `triple` of each token of each
    text (the pair ends with the token, the triple begins with that pair), and each token's text."""

    codes: int
    pairs: np.ndarray
    triples: np.ndarray
    pair: np.ndarray
    triple: np.ndarray
    doc: np.ndarray

    @classmethod
    def of(cls, words: np.ndarray, sizes: np.ndarray, codes: int, marks: tuple[int, int, int]) -> Grams:
        """From the codes of all words, the words of each text, and the codes of START, END and PAD."""
        docs = len(sizes)
        starts = np.concatenate([[0], np.cumsum(sizes + 3)[:-1]]).astype(np.int64) if docs else np.zeros(0, np.int64)
        text = np.empty(len(words) + 3 * docs, np.int64)
        inside = np.ones(len(text), np.bool_)
        for mark, at in zip(marks, (starts, starts + sizes + 1, starts + sizes + 2), strict=True):
            text[at], inside[at] = mark, False
        text[inside] = words
        begins = np.ones(len(text), np.bool_)
        begins[starts + sizes + 1], begins[starts + sizes + 2] = False, False
        at = np.flatnonzero(begins)
        pairs, pair = np.unique(text[at] * codes + text[at + 1], return_inverse=True)
        triples, triple = np.unique(pair * codes + text[at + 2], return_inverse=True)
        return cls(codes, pairs, triples, pair, triple, np.repeat(np.arange(docs), sizes + 1))


def score_documents(docs: DataFrame, folds: int = 10, mu: float = 100.0, nu: float = 2.0, add: float = 0.1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Scores of each text by a trigram model of the texts whose crc32(id as text) modulo `folds` is not 0.

    doc_id; held_out (that remainder is 0); n_tokens (words, A-Z in lower case, and one end); n_known (tokens seen in
    training); train_tokens; base_score: sum of log10((c + add) / (N + add (V + 1))) over the tokens; score: log10
    probability of the text, with the weights `mu` and `nu` of the lower orders. Null and empty texts have the end only.
    A null id counts as the text "None", is scored and stays null; repeated rows are trained on and scored like any
    others. Other columns are not read. An empty table gives an empty result; without training rows every probability
    is that of an unseen word.
    """
    spark = docs.sparkSession
    docs = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    corpus = spark.sparkContext.broadcast(_count_words(docs, folds))  # at most _DEALT words of 24 bytes

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = corpus.value
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(few(batches)):
            name = (part << 32) | number
            train = _training(batch.column("doc_id"), folds)
            words = split_words(batch.column("text"), lower=True)
            hashes = np.concatenate([words.hashes(), [START, END, PAD]]).astype(np.uint64)
            order = np.argsort(hashes, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            hashes = hashes[order]
            sizes, codes = np.diff(words.docs), rank[words.codes]
            grams = Grams.of(codes, sizes, len(hashes), tuple(rank[-3:].tolist()))
            ids = np.array([x if x is not None else -1 for x in batch.column("doc_id").to_pylist()], np.int64)
            dealt = np.flatnonzero(own.dealt_place(hashes) >= 0)
            dealt_counts = own.known_counts(hashes[dealt], np.zeros(len(dealt), np.int64))
            head = _pack(ids, np.array(batch.column("doc_id").is_valid()), train, sizes.astype(np.int64), np.append(rank[-3:], len(hashes)), dealt, dealt_counts, codes.astype(np.uint32))
            rows = [(-1 - name, name, head)]
            first, second = grams.pairs // len(hashes), grams.pairs % len(hashes)
            to = own.range(hashes[first], hashes[second])
            cuts = np.append(np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])), len(to)) if len(to) else np.zeros(1, np.int64)
            below = np.searchsorted(grams.triples, np.arange(len(to) + 1) * len(hashes))
            seen = np.bincount(grams.triple, train[grams.doc], len(grams.triples)).astype(np.uint32)
            seconds, thirds = _finger(hashes[second], _PAIR_BITS), _finger(hashes[grams.triples % len(hashes)], _TRIPLE_BITS)
            of_pair = (grams.triples // len(hashes)).astype(np.uint64)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                fresh = np.concatenate([[True], first[a + 1 : b] != first[a : b - 1]])
                inner = slice(below[a], below[b])
                words_steps = _steps(hashes[first[a:b][fresh]])
                pair_steps = _steps(((np.cumsum(fresh) - 1).astype(np.uint64) << np.uint64(_PAIR_BITS)) | seconds[a:b])
                triple_steps = _steps(((of_pair[inner] - np.uint64(a)) << np.uint64(_TRIPLE_BITS)) | thirds[inner])
                rows.append((int(to[a]), name, _pack(words_steps, pair_steps, triple_steps, seen[inner])))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["range", "slice", "blob"])

    def answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return table.select(["slice", "range", "blob"])
        own = corpus.value
        parts = [_unpack(x, "u8", "u8", "u8", "u4") for x in table["blob"].to_pylist()]
        asked = [[np.cumsum(steps) for steps in p[:3]] for p in parts]
        words, word = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
        pairs, pair = _numbered([a[1] for a in asked], word, [len(a[0]) for a in asked], _PAIR_BITS)
        keys, back = _numbered([a[2] for a in asked], pair, [len(a[1]) for a in asked], _TRIPLE_BITS)
        seen = np.bincount(back, np.concatenate([p[3] for p in parts]), len(keys)).astype(np.int64)
        of_pair, of_word = (keys >> np.uint64(_TRIPLE_BITS)).astype(np.int64), (pairs >> np.uint64(_PAIR_BITS)).astype(np.int64)
        pair_seen = np.bincount(of_pair, seen, len(pairs)).astype(np.int64)
        word_seen = own.known_counts(words, np.bincount(of_word, pair_seen, len(words)).astype(np.int64))
        trie = _trie(words, word_seen, pairs, pair_seen, keys, seen, mu, nu)
        number = trie.words.find(words)
        counts = np.zeros(len(words), np.int64)
        counts[number >= 0] = trie.counts[number[number >= 0]]
        place = trie.pairs.find(number[of_word], pairs & np.uint64((1 << _PAIR_BITS) - 1))
        after = trie.triples.find(place[of_pair], keys & np.uint64((1 << _TRIPLE_BITS) - 1))
        pair_code, rest_code = trie.read("pair", place, Trie.NONE), trie.read("rest", place, 0)
        triple_code = trie.read("triple", after, Trie.NONE)
        out, at = [], np.zeros(3, np.int64)
        for a in asked:
            to = at + [len(x) for x in a]
            mine, two = word[at[0] : to[0]], pair[at[1] : to[1]]
            alone = own.dealt_place(words[mine]) < 0
            out.append(_pack(counts[mine[alone]].astype(np.uint32), pair_code[two], rest_code[two], triple_code[back[at[2] : to[2]]]))
            at = to
        return pa.table({"slice": table["slice"], "range": table["range"], "blob": pa.array(out, pa.binary())})

    def total(table: pa.Table) -> pa.Table:
        own = corpus.value
        table = table.sort_by("range")  # the slice's own row, then the replies
        raws = table["blob"].to_pylist()
        ids, known_id, train, sizes, marks, dealt, dealt_counts, codes = _unpack(raws[0], "i8", "?", "?", "i8", "i8", "i8", "i8", "u4")
        start, end, pad, n = marks.tolist()
        grams = Grams.of(codes.astype(np.int64), sizes, n, (start, end, pad))
        replies = [_unpack(raw, "u4", "u1", "u1", "u1") for raw in raws[1:]]
        counts, pair, rest, triple = (np.concatenate([r[k] for r in replies]) for k in range(4))
        first, second = grams.pairs // n, grams.pairs % n
        seen = np.zeros(n, np.int64)
        asked = np.zeros(n, np.bool_)
        asked[first] = True
        asked[dealt] = False
        seen[asked] = counts
        seen[dealt] = dealt_counts
        seen[[start, end]] = own.train_docs
        p1 = (seen + add) / (own.tokens + add * (own.distinct + 1))
        p2 = Trie.value(pair) + mu / (seen[first] + mu) * p1[second]
        p = p2[grams.pair]
        later = np.flatnonzero(grams.doc[1:] == grams.doc[:-1])  # tokens with two before them
        p[later + 1] = Trie.value(triple)[grams.triple[later]] + Trie.value(rest)[grams.pair[later]] * p[later + 1]
        word = second[grams.pair]
        sums = [np.bincount(grams.doc, x, len(ids)) for x in (np.log10(p), np.log10(p1)[word], seen[word] > 0)]
        return pa.table(
            {
                "doc_id": pa.array(ids, mask=~known_id),
                "held_out": ~train,
                "n_tokens": sizes + 1,
                "n_known": sums[2].astype(np.int64),
                "train_tokens": np.full(len(ids), own.tokens, np.int64),
                "base_score": sums[1],
                "score": sums[0],
            }
        )

    answers = arrow_map(docs, requests, "range long, slice long, blob binary").groupBy("range").applyInArrow(answer, "slice long, range long, blob binary")
    return answers.groupBy("slice").applyInArrow(total, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _finger(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes >> np.uint64(64 - bits)


def _numbered(keys: list[np.ndarray], parent: np.ndarray, parents: list[int], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (parent << bits | fingerprint) and which one each key is; the keys of a slice number its own parents."""
    begins = np.cumsum([0, *parents[:-1]])
    own = np.concatenate([parent[(k >> np.uint64(bits)).astype(np.int64) + b] for k, b in zip(keys, begins, strict=True)])
    return np.unique((own.astype(np.uint64) << np.uint64(bits)) | (np.concatenate(keys) & np.uint64((1 << bits) - 1)), return_inverse=True)


def _trie(words: np.ndarray, word_seen: np.ndarray, pairs: np.ndarray, pair_seen: np.ndarray, triples: np.ndarray, seen: np.ndarray, mu: float, nu: float) -> Trie:
    """The trie of what training texts hold of a range. The upper bits of pairs and triples number words and pairs."""
    of_word, of_pair = (pairs >> np.uint64(_PAIR_BITS)).astype(np.int64), (triples >> np.uint64(_TRIPLE_BITS)).astype(np.int64)
    kept_words, kept_pairs, kept = np.bincount(of_word, pair_seen, len(words)) > 0, pair_seen > 0, seen > 0
    ends = lambda of, parents, children: np.concatenate([[0], np.cumsum(np.bincount(of[children], minlength=len(parents))[parents])])
    context = pair_seen[of_pair[kept]]
    return Trie(
        words[kept_words],
        word_seen[kept_words],
        (ends(of_word, kept_words, kept_pairs), pairs[kept_pairs] & np.uint64((1 << _PAIR_BITS) - 1), _PAIR_BITS),
        (ends(of_pair, kept_pairs, kept), triples[kept] & np.uint64((1 << _TRIPLE_BITS) - 1), _TRIPLE_BITS),
        pair=np.log10(pair_seen[kept_pairs] / (word_seen[of_word[kept_pairs]] + mu)),
        rest=np.log10(nu / (pair_seen[kept_pairs] + nu)),
        triple=np.log10(seen[kept] / (context + nu)),
    )
