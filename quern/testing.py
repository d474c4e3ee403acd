"""Random values of any kind, with the edges that break things, and a shrinker; for differential tests."""

from __future__ import annotations

import datetime
import decimal
import random
from collections.abc import Callable, Iterator
from typing import Any

from quern.types import BINARY, BOOL, DATE, DURATION, FLOATING, INTEGRAL, STRING, TIMESTAMP, Dec, Enum, Kind, Map, Opt, Product, Seq, Some, Sum, assemble, camel, is_opt, kind_of

_FLOATS = [0.0, -0.0, float("inf"), float("-inf"), float("nan"), 5e-324, 1.7976931348623157e308, -1.7976931348623157e308]


def arbitrary(model: Any, rng: random.Random) -> Any:
    """A value of a model: uniform most of the time, an edge value otherwise; collections of up to 5."""
    return _value(kind_of(model), rng)


def _value(kind: Kind, rng: random.Random) -> Any:
    if isinstance(kind, Opt):
        if rng.random() < 0.3:
            return None
        inner = _value(kind.of, rng)
        return Some(inner) if is_opt(kind.of) else inner
    if isinstance(kind, Seq):
        return [_value(kind.of, rng) for _ in range(rng.randint(0, 5))]
    if isinstance(kind, Map):
        return {k: _value(kind.value, rng) for k in (_value(kind.key, rng) for _ in range(rng.randint(0, 5)))}
    if isinstance(kind, Product):
        return assemble(kind, [_value(k, rng) for _, k in kind.fields])
    if isinstance(kind, Sum):
        _, variant = rng.choice(kind.variants)
        return _value(variant, rng)
    if isinstance(kind, Enum):
        name = rng.choice(kind.values)
        return next((m for m in kind.cls if camel(m.name) == name), name) if kind.cls else name
    if isinstance(kind, Dec):
        return decimal.Decimal(rng.randint(-(10**kind.precision) + 1, 10**kind.precision - 1)).scaleb(-kind.scale, decimal.Context(prec=40))
    if kind in INTEGRAL:
        bits = (7, 15, 31, 63)[INTEGRAL.index(kind)]
        return rng.choice([0, -(2**bits), 2**bits - 1]) if rng.random() < 0.3 else rng.randint(-(2**bits), 2**bits - 1)
    if kind in FLOATING:
        return rng.choice(_FLOATS) if rng.random() < 0.3 else rng.uniform(-1, 1) * 10.0 ** rng.randint(-30, 30)
    if kind == STRING:
        if rng.random() < 0.5:
            return "".join(chr(rng.randint(32, 126)) for _ in range(rng.randint(0, 5)))
        return "".join(chr(c) for c in (rng.choice([rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x10FFFF)]) for _ in range(rng.randint(0, 4))))
    if kind == BINARY:
        return rng.randbytes(rng.randint(0, 19))
    if kind == BOOL:
        return rng.random() < 0.5
    if kind == DATE:
        return datetime.date.fromordinal(rng.randint(1, datetime.date.max.toordinal()))
    if kind == TIMESTAMP:
        return datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(microseconds=rng.randint(-(10**15), 10**16))
    assert kind == DURATION
    return datetime.timedelta(microseconds=rng.randint(-(10**15), 10**15))


def smaller_lists(rows: list) -> Iterator[list]:
    """Lists that might show the same failure: halves, then without one row."""
    if len(rows) > 1:
        yield rows[: len(rows) // 2]
        yield rows[len(rows) // 2 :]
    for k in range(len(rows)):
        yield rows[:k] + rows[k + 1 :]


def for_all(model: Any, test: Callable[[list], None], runs: int = 5, most: int = 5, seed: int = 0) -> None:
    """Run a test on random lists of rows; report the smallest list that fails."""
    rng = random.Random(seed)
    for _ in range(runs):
        rows = [arbitrary(model, rng) for _ in range(rng.randint(0, most))]
        problem = _failure(test, rows)
        while problem:
            for less in smaller_lists(rows):
                if again := _failure(test, less):
                    rows, problem = less, again
                    break
            else:
                raise AssertionError(f"fails for {rows!r}: {problem}") from problem


def _failure(test: Callable[[list], None], rows: list) -> Exception | None:
    try:
        test(rows)
    except Exception as e:  # noqa: BLE001  any failure is a finding
        return e
    return None
