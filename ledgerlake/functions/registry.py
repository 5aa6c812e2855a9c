"""Function registry of the query language: typed overloads that build Column expressions.

An overload is chosen by exact types first, then fewest widenings (int to decimal), then ``any``;
a tie is ambiguous. Functions are strict (Spark expressions give NULL for NULL) unless they say so.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from ledgerlake.plans.syntax import QueryError

TYPES = ("bool", "int", "decimal", "string", "date", "amount", "position", "inventory", "interval", "set", "dict", "entry", "meta", "null")


@dataclass(frozen=True)
class Function:
    name: str
    ins: tuple[str, ...]
    out: str
    build: Callable[..., Any]
    aggregate: bool = False
    context: bool = False


_functions: dict[str, list[Function]] = {}


def register(name: str, ins: str | tuple[str, ...], out: str, build: Callable[..., Any], aggregate: bool = False, context: bool = False) -> Function:
    """Add an overload. ``context``: build gets the query context first. The same signature twice is an error."""
    ins = tuple(ins.split()) if isinstance(ins, str) else ins
    unknown = [t for t in (*ins, out) if t not in (*TYPES, "any")]
    if unknown:
        raise ValueError(f"unknown types {unknown}")
    f = Function(name.lower(), ins, out, build, aggregate, context)
    have = _functions.setdefault(f.name, [])
    if any(x.ins == ins for x in have):
        raise ValueError(f"{name}({', '.join(ins)}) is registered")
    have.append(f)
    return f


def unregister(name: str, ins: str | tuple[str, ...]) -> None:
    ins = tuple(ins.split()) if isinstance(ins, str) else ins
    _functions[name.lower()] = [x for x in _functions.get(name.lower(), []) if x.ins != ins]


def function(ins: str, out: str, name: str | None = None, **kw):
    """Decorator form of ``register``; may be stacked for several overloads."""

    def add(build):
        register(name or build.__name__.rstrip("_"), ins, out, build, **kw)
        return build

    return add


def names() -> list[str]:
    return sorted(k for k, v in _functions.items() if v)


def _penalty(want: str, have: str) -> tuple[int, int] | None:
    if want == have or have == "null":
        return (0, 0)
    if want == "decimal" and have == "int":
        return (1, 0)
    if want == "any":
        return (0, 1)
    if have == "meta" and want == "any":
        return (0, 1)
    return None


def resolve(name: str, args: list[str], pos: int = 0) -> Function:
    every = _functions.get(name.lower())
    if not every:
        raise QueryError(f"no function {name}", pos)
    found = []
    for f in every:
        if len(f.ins) == len(args) and None not in (p := [_penalty(w, h) for w, h in zip(f.ins, args, strict=True)]):
            found.append(((sum(x[1] for x in p), sum(x[0] for x in p)), f))
    if not found:
        raise QueryError(f"no {name}({', '.join(args)})", pos)
    best = min(x[0] for x in found)
    same = [f for k, f in found if k == best]
    if len(same) > 1 and "null" not in args:
        raise QueryError(f"{name}({', '.join(args)}) is ambiguous", pos)
    return same[0]


def is_aggregate(name: str) -> bool:
    return any(f.aggregate for f in _functions.get(name.lower(), []))
