"""Updates as pure functions from document to document: what a mutation does to one of them."""

from __future__ import annotations

import math
from typing import Any

from .values import I64, ValueProblem, equal, kind


class UpdateProblem(ValueProblem):
    """An update that one of the documents doesn't allow; none is changed then."""


def _parent(doc: dict, parts: list[str], make: bool) -> dict | None:
    at = doc
    for p in parts:
        if p not in at:
            if not make:
                return None
            at[p] = {}
        if kind(at[p]) != "object":
            if make:
                raise UpdateProblem("the path crosses a value that is no object")
            return None
        at[p] = dict(at[p])
        at = at[p]
    return at


def _exact(n: int) -> float:
    if int(float(n)) != n:
        raise UpdateProblem("$inc would lose precision")
    return float(n)


def total(a: Any, b: Any) -> Any:
    """The sum of two numbers; of one kind each, or of both where the integer is exact as a float."""
    if kind(a) not in ("int64", "float64"):
        raise UpdateProblem("$inc needs a number")
    if kind(a) == kind(b) == "int64":
        if not I64[0] <= a + b <= I64[1]:
            raise UpdateProblem("$inc leaves the integer range")
        return a + b
    s = (_exact(a) if kind(a) == "int64" else a) + (_exact(b) if kind(b) == "int64" else b)
    if not math.isfinite(s):
        raise UpdateProblem("$inc leaves the range of floats")
    return s


def apply(doc: dict, plan: list[tuple[str, str, Any]]) -> dict:
    """The document after compiled operations (operator, path, value); the one given stays as it is."""
    out = dict(doc)
    for op, path, v in plan:
        *head, name = path.split(".")
        at = _parent(out, head, op != "$unset" and (op != "$pull" or _present(out, path)))
        if op == "$unset":
            if at is not None:
                at.pop(name, None)
        elif op == "$set":
            at[name] = v
        elif op == "$inc":
            at[name] = total(at[name], v) if name in at else v
        elif at is not None and (op == "$push" or name in at):
            old = at.get(name, [])
            if kind(old) != "array":
                raise UpdateProblem(f"{op} needs an array")
            at[name] = [*old, v] if op == "$push" else [e for e in old if not equal(e, v)]
    return out


def _present(doc: dict, path: str) -> bool:
    at: Any = doc
    for p in path.split("."):
        if not isinstance(at, dict) or p not in at:
            return False
        at = at[p]
    return True


def modified(before: dict, after: dict) -> bool:
    """1 and 1.0 are equal, so setting one to the other changes nothing."""
    return not equal(before, after)
