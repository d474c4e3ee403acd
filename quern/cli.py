"""Command lines from dataclasses: kebab-case flags, nested prefixes, defaults, several values, alternatives."""

from __future__ import annotations

import dataclasses
import datetime
import enum
import types
import typing
from dataclasses import dataclass
from typing import Any

from quern.types import camel


class ArgsError(ValueError):
    """What is wrong with a command line, one line for each problem."""

    def __init__(self, problems: list[str]):
        super().__init__("\n".join(problems))
        self.problems = problems


class HelpWanted(Exception):
    """--help was given; the text is the message."""


@dataclass(frozen=True)
class _Flag:
    name: str
    kind: Any
    default: Any
    many: bool
    optional: bool


def kebab(name: str) -> str:
    return "".join("-" + c.lower() if c.isupper() else "-" if c == "_" else c for c in name).lstrip("-")


def _plain(kind: Any) -> tuple[Any, bool, bool]:
    """(kind of one value, several, optional)."""
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin is typing.Annotated:
        return _plain(args[0])
    if origin in (typing.Union, types.UnionType):
        rest = [a for a in args if a is not type(None)]
        if len(rest) == 1:
            one, many, _ = _plain(rest[0])
            return one, many, True
    if origin in (list, set, tuple):
        return _plain(args[0])[0], True, False
    return kind, False, False


def _alternatives(kind: Any) -> list[type]:
    """The dataclasses of a union or of a sealed base class."""
    if typing.get_origin(kind) in (typing.Union, types.UnionType):
        return [a for a in typing.get_args(kind) if dataclasses.is_dataclass(a)]
    return kind.__subclasses__() if isinstance(kind, type) and kind.__dict__.get("__sealed__") is kind else []


def _walk(cls: type, prefix: str = "") -> list[tuple[str, _Flag | list[type] | type]]:
    """(field, flag, alternatives or nested dataclass) in order."""
    out = []
    hints = typing.get_type_hints(cls, include_extras=True)
    for f in dataclasses.fields(cls):
        name = prefix + kebab(f.name)
        default = f.default if f.default is not dataclasses.MISSING else f.default_factory() if f.default_factory is not dataclasses.MISSING else dataclasses.MISSING
        kind, many, optional = _plain(hints[f.name])
        out.append((f.name, _Flag(name, kind, default, many, optional)))
    return out


def parse_value(kind: Any, text: str) -> Any:
    if kind is bool:
        if text.lower() in ("true", "false"):
            return text.lower() == "true"
        raise ValueError(f"{text!r} is neither true nor false")
    if kind in (int, float):
        return kind(text)
    if kind is datetime.date:
        return datetime.date.fromisoformat(text)
    if kind is datetime.datetime:
        return datetime.datetime.fromisoformat(text)
    if isinstance(kind, type) and issubclass(kind, enum.Enum):
        for m in kind:
            if camel(m.name) == text or kebab(m.name) == text:
                return m
        raise ValueError(f"{text!r} is none of {', '.join(camel(m.name) for m in kind)}")
    return text


def _split(argv: list[str]) -> tuple[dict[str, list[str]], list[str]]:
    given: dict[str, list[str]] = {}
    problems, name = [], None
    for a in argv:
        if a.startswith("--"):
            name, eq, value = a[2:].partition("=")
            given.setdefault(name, [])
            if eq:
                given[name].append(value)
                name = None
        elif name is None:
            problems.append(f"unexpected value {a!r}")
        else:
            given[name].append(a)
    return given, problems


def parse(cls: type, argv: list[str]) -> Any:
    """An object of `cls` from a command line; all problems at once."""
    if "--help" in argv:
        raise HelpWanted(usage(cls))
    given, problems = _split(argv)
    used: set[str] = set()
    value = _build(cls, "", given, used, problems)
    problems += [f"unknown flag --{n}" for n in given if n not in used]
    if problems:
        raise ArgsError(problems)
    return value


def _build(cls: type, prefix: str, given: dict[str, list[str]], used: set[str], problems: list[str]) -> Any:
    values, before = {}, len(problems)
    for name, flag in _walk(cls, prefix):
        kinds = _alternatives(flag.kind)
        if kinds or dataclasses.is_dataclass(flag.kind):
            inside = f"{flag.name}-"
            here = [n for n in given if n == flag.name or n.startswith(inside)]
            if not here and flag.default is not dataclasses.MISSING:
                values[name] = flag.default
            elif not here and flag.optional:
                values[name] = None
            elif not here and kinds:
                problems.append(f"--{flag.name} is missing")
            elif kinds:
                values[name] = _choose(kinds, flag.name, inside, given, used, problems)
            else:
                values[name] = _build(flag.kind, inside, given, used, problems)
            continue
        used.add(flag.name)
        if flag.name not in given:
            if flag.default is not dataclasses.MISSING:
                values[name] = flag.default
            elif flag.optional:
                values[name] = None
            elif flag.many:
                values[name] = []
            else:
                problems.append(f"--{flag.name} is missing")
            continue
        texts = given[flag.name]
        if flag.kind is bool and not texts and not flag.many:
            texts = ["true"]
        if not flag.many and len(texts) != 1:
            problems.append(f"--{flag.name} takes one value, not {len(texts)}")
            continue
        try:
            parsed = [parse_value(flag.kind, t) for t in texts]
            values[name] = parsed if flag.many else parsed[0]
        except ValueError as e:
            problems.append(f"--{flag.name}: {e}")
    return cls(**values) if len(problems) == before else None


def _choose(kinds: list[type], name: str, inside: str, given: dict[str, list[str]], used: set[str], problems: list[str]) -> Any:
    """Tagged (--name variant) or untagged: the one alternative whose flags all fit."""
    if name in given:
        used.add(name)
        tag = (given[name] or [""])[0]
        for k in kinds:
            if tag in (camel(k.__name__), kebab(k.__name__)):
                return _build(k, inside, given, used, problems)
        problems.append(f"--{name}: {tag!r} is none of {', '.join(kebab(k.__name__) for k in kinds)}")
        return None
    fitting = []
    for k in kinds:
        own_used: set[str] = set()
        own: list[str] = []
        value = _build(k, inside, given, own_used, own)
        if not own and all(n in own_used for n in given if n.startswith(inside)):
            fitting.append((value, own_used))
    if len(fitting) != 1:
        problems.append(f"--{name}: the flags fit {len(fitting)} of {', '.join(kebab(k.__name__) for k in kinds)}")
        used.update(n for n in given if n.startswith(inside))
        return None
    used.update(fitting[0][1])
    return fitting[0][0]


def unparse(value: Any, prefix: str = "") -> list[str]:
    """A command line that parses to the value again."""
    out: list[str] = []
    for name, flag in _walk(type(value), prefix):
        own = getattr(value, name)
        if own is None:
            continue
        if dataclasses.is_dataclass(own):
            if _alternatives(flag.kind):
                out += [f"--{flag.name}", kebab(type(own).__name__)]
            out += unparse(own, f"{flag.name}-")
        elif flag.many:
            out += [f"--{flag.name}", *map(_text, own)] if own else []
        else:
            out += [f"--{flag.name}", _text(own)]
    return out


def _text(value: Any) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, enum.Enum):
        return camel(value.name)
    return value.isoformat() if isinstance(value, datetime.date) else str(value)


def usage(cls: type, prefix: str = "") -> str:
    """One line for each flag, with its kind, default and documentation."""
    lines = []
    notes = {f.name: f.metadata.get("doc", "") for f in dataclasses.fields(cls)}
    for name, flag in _walk(cls, prefix):
        kinds = _alternatives(flag.kind)
        if kinds:
            lines.append(f"--{flag.name} {'|'.join(kebab(k.__name__) for k in kinds)}")
            lines += [usage(k, f"{flag.name}-") for k in kinds if dataclasses.fields(k)]
        elif dataclasses.is_dataclass(flag.kind):
            lines.append(usage(flag.kind, f"{flag.name}-"))
        else:
            default = "" if flag.default is dataclasses.MISSING else f" (default {_text(flag.default) if flag.default is not None else 'none'})"
            lines.append(f"--{flag.name} <{getattr(flag.kind, '__name__', flag.kind)}>{'...' if flag.many else ''}{default} {notes[name]}".rstrip())
    return "\n".join(x for x in lines if x)
