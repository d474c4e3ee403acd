"""Pre-tokenisation without regular expressions.

Every code point gets a symbol (its class plus what little of the following text decides). A symbol is a function from
automaton state to automaton state, and functions compose associatively: the text is cut into equal chunks, each chunk's
state map is computed for all start states at once, a parallel prefix scan composes the maps, and a second pass from the
now known start states marks where pre-tokens begin. Documents need no padding between them: the first symbol of a
document is a constant function.

Alternatives in order: a contraction ('s 't 're 've 'm 'll 'd), an optional space with letters, with numbers, or with
other visible characters, white space not followed by a visible character, white space.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

LETTER, NUMBER, OTHER, QUOTE, QUOTE1, QUOTE2, SPACE_END, SPACE, BLANK_END, BLANK = range(10)
_SYMBOLS = 10
#: States: nothing read, in letters, in numbers, in others, after a space that the next run takes, in white space, one or two letters of a contraction to go, contraction complete.
S_NONE, S_LETTER, S_NUMBER, S_OTHER, S_TAKEN, S_BLANK, S_ONE, S_TWO, S_DONE = range(9)
_STATES = 9
_CHUNK = 96


#: Classes of code points, before what follows is looked at.
_C_LETTER, _C_NUMBER, _C_OTHER, _C_QUOTE, _C_SPACE, _C_BLANK = range(6)


@cache
def classes() -> np.ndarray:
    """The class of each code point."""
    out = np.full(0x110000, _C_OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = _C_LETTER
        elif kind == "N":
            out[cp] = _C_NUMBER
    blanks = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    out[blanks] = _C_BLANK
    out[0x20], out[0x27] = _C_SPACE, _C_QUOTE
    return out


@cache
def transitions() -> np.ndarray:
    """state + 16 if a token begins, by symbol * 32 + (state, or state + 16); symbols from _SYMBOLS on are first in their document."""
    out = np.zeros((2 * _SYMBOLS, 32), np.int64)
    runs = {LETTER: S_LETTER, NUMBER: S_NUMBER, OTHER: S_OTHER, QUOTE: S_OTHER, QUOTE1: S_OTHER, QUOTE2: S_OTHER}
    for symbol in range(_SYMBOLS):
        for state in range(_STATES):
            if symbol == LETTER and state in (S_ONE, S_TWO):
                to, begins = (S_DONE if state == S_ONE else S_ONE), False
            elif symbol in runs and state in (runs[symbol], S_TAKEN):
                to, begins = runs[symbol], False
            elif symbol in (QUOTE1, QUOTE2):
                to, begins = (S_ONE if symbol == QUOTE1 else S_TWO), True
            elif symbol in runs:
                to, begins = runs[symbol], True
            elif symbol == SPACE_END:
                to, begins = S_TAKEN, True
            elif symbol == BLANK_END:
                to, begins = S_BLANK, True
            else:
                to, begins = S_BLANK, state != S_BLANK
            out[symbol, [state, state + 16]] = to + 16 * begins
    out[_SYMBOLS:] = out[:_SYMBOLS, S_NONE][:, None] | 16
    return out.ravel()


@cache
def constants() -> np.ndarray:
    """Which symbols lead to the same state from every state: after one of them a chunk's start no longer matters."""
    return (transitions().reshape(-1, 32)[:, :_STATES] % 16).std(axis=1) == 0


@cache
def _symbol_of() -> np.ndarray:
    """By 2 * class + (followed by a visible character of the same document)."""
    plain = {_C_LETTER: LETTER, _C_NUMBER: NUMBER, _C_OTHER: OTHER, _C_QUOTE: QUOTE}
    return np.array([plain.get(c, (SPACE, SPACE_END)[seen] if c == _C_SPACE else (BLANK, BLANK_END)[seen]) for c in range(6) for seen in (0, 1)], np.uint8)


def symbols(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """A symbol per code point; `firsts` are the indices that begin a document."""
    kind = classes().take(points)
    n = len(kind)
    code = kind * 2
    code[:-1] += kind[1:] < _C_SPACE
    ends = firsts[firsts > 0] - 1
    code[ends] = kind[ends] * 2
    out = _symbol_of().take(code)
    quotes = np.flatnonzero(kind == _C_QUOTE)
    if len(quotes):
        first = np.zeros(n + 3, np.bool_)
        first[firsts] = True
        first[n:] = True
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        a, b = padded[quotes + 1], padded[quotes + 2]
        a = np.where(first[quotes + 1], 0, a)
        b = np.where(first[quotes + 1] | first[quotes + 2], 0, b)
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        out[quotes] = np.where(one, QUOTE1, np.where(two, QUOTE2, QUOTE))
    out[firsts] += _SYMBOLS
    return out


def compose_prefix(maps: np.ndarray) -> np.ndarray:
    """Inclusive parallel prefix scan: row i becomes maps[0] then maps[1] ... then maps[i]."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], axis=1)
        step *= 2
    return maps


def _run(rows: np.ndarray, state: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """The states after all rows of symbols (times 32), from `state`; `out` keeps every step."""
    table, state = transitions(), state.astype(np.int64)
    at = np.empty_like(state)
    for k in range(len(rows)):
        np.add(rows[k], state, out=at)
        table.take(at, out=state, mode="clip")
        if out is not None:
            out[k] = state
    return state % 16


def begins(syms: np.ndarray) -> np.ndarray:
    """Whether each position begins a pre-token."""
    n = len(syms)
    if not n:
        return np.zeros(0, np.bool_)
    chunks = -(-n // _CHUNK)
    padded = np.full(chunks * _CHUNK, _SYMBOLS + BLANK, np.uint8)
    padded[:n] = syms
    rows = np.ascontiguousarray(padded.reshape(chunks, _CHUNK).T)
    fixed = constants().take(rows)
    settled = np.where(fixed.any(axis=0), fixed.argmax(axis=0), _CHUNK)  # from here on the start state doesn't matter
    rows = rows.astype(np.int16) * 32
    steps = np.empty((_CHUNK, chunks), np.uint8)
    maps = np.repeat(_run(rows, np.zeros(chunks), steps)[:, None], _STATES, axis=1)
    open_ = np.flatnonzero(settled == _CHUNK)
    for s in range(1, _STATES):
        maps[open_, s] = _run(rows[:, open_], np.full(len(open_), s))
    before = np.zeros(chunks, np.int64)
    before[1:] = compose_prefix(maps)[:-1, S_NONE]
    table = transitions()
    todo = np.flatnonzero(before)  # steps began in state 0; redo what lies before the settled place
    state = before[todo]
    for k in range(_CHUNK):
        more = settled[todo] >= k
        todo, state = todo[more], state[more]
        if not len(todo):
            break
        state = table[rows[k, todo] + state]
        steps[k, todo] = state
    return (np.ascontiguousarray(steps.T).ravel()[:n] & 16) != 0


def pretokens(data: np.ndarray, offsets: np.ndarray, atoms: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (with the end) of all pre-tokens of UTF-8 `data`, and the number of pre-tokens before each document.

    `offsets`: documents' byte offsets, n + 1. `atoms`: [start, end) byte ranges that are one token each and bound the text around them.
    """
    if not len(data):
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(points) == len(data):
        at_byte = None
        to_char = lambda x: x
    else:
        lead = (data & 0xC0) != 0x80
        at_byte = np.flatnonzero(lead)
        counts = np.concatenate([[0], np.cumsum(lead)])
        to_char = lambda x: counts[x]
    edges = offsets if atoms is None else np.concatenate([offsets, atoms.ravel()])
    firsts = to_char(edges)
    marks = begins(symbols(points, firsts[firsts < len(points)]))
    if atoms is not None:
        for a, b in to_char(atoms):
            marks[a + 1 : b] = False
    starts = np.flatnonzero(marks)
    before = np.searchsorted(starts, to_char(offsets))
    if at_byte is not None:
        starts = at_byte[starts]
    return np.append(starts, len(data)), before
