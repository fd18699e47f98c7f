"""Filters as data: a Mongo-like map or tagged JSON becomes a tree of nodes.

Nodes are plain tuples: ("true",) ("and", [..]) ("or", [..]) ("not", n) (op, path, value) for
eq gt gte lt lte, ("in", path, values) ("exists", path) ("size", path, n) ("type", path, kinds)
("all", path, values) ("elem", path, node) with field paths inside, ("elem_scalar", path, node)
with the path None standing for the element itself."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from larkdoc.functions.values import KINDS, Id, ValueProblem, check_path, equal, kind

MAX_DEPTH, MAX_NODES, MAX_ITEMS, MAX_SORT, MAX_LIMIT = 16, 128, 256, 4, 10_000
Node = tuple
_COMPARE = {"$eq": "eq", "$gt": "gt", "$gte": "gte", "$lt": "lt", "$lte": "lte"}
_SCALAR = {*_COMPARE, "$ne", "$in", "$nin", "$and", "$or", "$not"}


class FilterProblem(ValueError):
    """A filter the language doesn't have."""


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise FilterProblem(what)


def both(nodes: list[Node]) -> Node:
    return nodes[0] if len(nodes) == 1 else ("and", nodes) if nodes else ("true",)


def compile_filter(f: dict) -> Node:
    node = _filter(f, 1)
    _need(count_nodes(node) <= MAX_NODES, f"a filter has {MAX_NODES} nodes at most")
    return node


def count_nodes(n: Node) -> int:
    return 1 + sum(count_nodes(x) for x in (n[1] if n[0] in ("and", "or") else [n[1]] if n[0] == "not" else [n[2]] if n[0].startswith("elem") else []))


def _filter(f: Any, depth: int) -> Node:
    _need(isinstance(f, dict), "a filter is an object")
    _need(depth <= MAX_DEPTH, f"filters nest {MAX_DEPTH} deep at most")
    out = []
    for key in sorted(f):
        v = f[key]
        if key in ("$and", "$or"):
            _need(isinstance(v, list) and 1 <= len(v) <= MAX_ITEMS, f"{key} takes 1 to {MAX_ITEMS} filters")
            out.append((key[1:], [_filter(x, depth + 1) for x in v]))
        elif key == "$not":
            out.append(("not", _filter(v, depth + 1)))
        else:
            _need(not key.startswith("$"), f"no operator {key}")
            check_path(key)
            out.append(_field(key, v, depth + 1))
    return both(out)


def _is_ops(v: Any) -> bool:
    return isinstance(v, dict) and any(k.startswith("$") for k in v)


def _field(path: str | None, v: Any, depth: int) -> Node:
    _need(depth <= MAX_DEPTH, f"filters nest {MAX_DEPTH} deep at most")
    if not _is_ops(v):
        return ("eq", path, _operand(path, v))
    out = []
    for op in sorted(v):
        x = v[op]
        _need(path is not None or op in _SCALAR, f"no operator {op} for elements")
        if op in _COMPARE:
            out.append((_COMPARE[op], path, _operand(path, x)))
        elif op == "$ne":
            out.append(("not", ("eq", path, _operand(path, x))))
        elif op in ("$in", "$nin"):
            _need(isinstance(x, list) and len(x) <= MAX_ITEMS, f"{op} takes {MAX_ITEMS} values at most")
            n = ("in", path, [_operand(path, e) for e in x])
            out.append(n if op == "$in" else ("not", n))
        elif op == "$exists":
            _need(isinstance(x, bool), "$exists takes a boolean")
            out.append(("exists", path) if x else ("not", ("exists", path)))
        elif op == "$size":
            _need(kind(x) in ("int64", "float64") and x == int(x) and 0 <= x <= 2**53 - 1, "$size takes a whole number")
            out.append(("size", path, int(x)))
        elif op == "$type":
            names = x if isinstance(x, list) else [x]
            _need(bool(names) and all(n in KINDS for n in names), "$type takes names of kinds")
            out.append(("type", path, [k for k in KINDS if k in names]))
        elif op == "$all":
            _need(isinstance(x, list) and 1 <= len(x) <= MAX_ITEMS, f"$all takes 1 to {MAX_ITEMS} values")
            seen: list = []
            for e in x:
                kind(e)
                if not any(equal(e, s) for s in seen):
                    seen.append(e)
            out.append(("all", path, seen))
        elif op == "$elemMatch":
            _need(isinstance(x, dict) and bool(x), "$elemMatch takes an object with content")
            scalar = [k for k in x if k in _SCALAR and not (k in ("$and", "$or", "$not") and not _scalar_arm(x[k]))]
            if all(k.startswith("$") for k in x) and len(scalar) == len(x):
                out.append(("elem_scalar", path, _scalar(x, depth + 1)))
            else:
                _need(all(not k.startswith("$") or k in ("$and", "$or", "$not") for k in x), "$elemMatch mixes fields and operators")
                out.append(("elem", path, _filter(x, depth + 1)))
        elif op == "$not":
            out.append(("not", _scalar(x, depth + 1) if path is None and _is_ops(x) else _field(path, x, depth + 1)))
        elif op in ("$and", "$or") and path is None:
            _need(isinstance(x, list) and 1 <= len(x) <= MAX_ITEMS, f"{op} takes 1 to {MAX_ITEMS} conditions")
            out.append((op[1:], [_scalar(e, depth + 1) for e in x]))
        else:
            raise FilterProblem(f"no operator {op}")
    return both(out)


def _scalar_arm(x: Any) -> bool:
    arms = x if isinstance(x, list) else [x]
    return all(isinstance(a, dict) and a and all(k.startswith("$") for k in a) for a in arms)


def _scalar(x: Any, depth: int) -> Node:
    _need(_is_ops(x) and all(k in _SCALAR for k in x), "an element condition takes operators")
    return _field(None, x, depth)


def _operand(path: str | None, v: Any) -> Any:
    if path == "_id" and isinstance(v, str):
        return Id(v)
    kind(v)
    return v


def paths(n: Node) -> set[str]:
    """Field paths a filter reads."""
    if n[0] in ("and", "or"):
        return set().union(*map(paths, n[1]))
    if n[0] == "not":
        return paths(n[1])
    if n[0] == "elem":
        return {n[1], *(f"{n[1]}.{p}" for p in paths(n[2]))}
    return {n[1]} if len(n) > 1 and n[1] else set()


def operators(n: Node) -> set[str]:
    if n[0] in ("and", "or"):
        return {n[0]}.union(*map(operators, n[1]))
    if n[0] == "not":
        return {"not"} | operators(n[1])
    return {n[0]} | (operators(n[2]) if n[0].startswith("elem") else set())


@dataclass(frozen=True)
class Query:
    """What to read: a filter, at most four sort fields, a window."""

    where: Node = ("true",)
    sort: tuple[tuple[str, int], ...] = ()
    skip: int = 0
    limit: int | None = None
    seek: bool = False  # pages by keyset: needs a sort and a limit

    def __post_init__(self) -> None:
        _need(len(self.sort) <= MAX_SORT and len({p for p, _ in self.sort}) == len(self.sort), f"{MAX_SORT} different sort fields at most")
        for p, d in self.sort:
            check_path(p)
            _need(d in (1, -1), "a sort direction is 1 or -1")
        _need(self.skip >= 0, "skip is 0 or more")
        _need(self.limit is None or 0 <= self.limit <= MAX_LIMIT, f"limit is 0 to {MAX_LIMIT}")
        _need(not self.seek or bool(self.sort) and self.limit is not None, "seek needs a sort and a limit")

    def capped(self, most: int) -> Query:
        return replace(self, limit=most if self.limit is None else min(self.limit, most))

    def constrain(self, rule: Node) -> Query:
        return replace(self, where=("and", [rule, self.where]))


def query(f: dict | None = None, sort=(), skip: int = 0, limit: int | None = None) -> Query:
    return Query(compile_filter(f or {}), tuple(sort), skip, limit)


def continuation(sort: list[tuple[str, int]], last: dict) -> Node:
    """Rows after `last` in the order of sort, as a filter; fields that aren't in last are missing."""
    for p, _ in sort:
        if p in last and kind(last[p]) in ("array", "object"):
            raise ValueProblem("a page can't end at an array or object")
    arms = []
    for i, (p, d) in enumerate(sort):
        before = [("eq", q, last[q]) if q in last else ("not", ("exists", q)) for q, _ in sort[:i]]
        if p in last:
            after = ("gt", p, last[p]) if d > 0 else ("or", [("lt", p, last[p]), ("not", ("exists", p))])
        elif d > 0:
            after = ("exists", p)
        else:
            continue
        arms.append(both([*before, after]))
    return ("or", arms) if arms else ("not", ("true",))
