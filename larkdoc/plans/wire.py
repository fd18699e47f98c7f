"""Queries, mutations and documents as strict tagged JSON: decoding with limits, canonical encoding."""

from __future__ import annotations

import json
from typing import Any

from larkdoc.functions.values import KINDS, ValueProblem, check_path, equal, from_wire, kind, strict_json, to_wire

from .filters import MAX_DEPTH, MAX_ITEMS, MAX_LIMIT, MAX_NODES, FilterProblem, Node, Query

MAX_BYTES, MAX_VALUE, MAX_SIZE = 1 << 20, 16_384, 2**53 - 1
FIELDS = {  # members of a node by its op, besides op itself
    "true": (), "and": ("args",), "or": ("args",), "not": ("arg",), "compare": ("cmp", "path", "value"), "in": ("path", "values"), "nin": ("path", "values"),
    "exists": ("path", "value"), "size": ("path", "size"), "type": ("path", "types"), "all": ("path", "values"), "elem_match": ("path", "mode", "arg"),
}
ELEMENT = ("and", "or", "not", "compare", "in", "nin")
COMPARE = ("eq", "ne", "gt", "gte", "lt", "lte")


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise FilterProblem(what)


def _parse(text: str, most: int = MAX_BYTES) -> Any:
    _need(len(text.encode()) <= most, "the text exceeds its limit")
    try:
        return strict_json(text)
    except (ValueError, RecursionError) as e:
        raise FilterProblem(str(e)) from e


def _members(w: Any, required: tuple, optional: tuple = ()) -> None:
    _need(isinstance(w, dict), "an object is needed")
    _need(set(required) <= set(w) <= {*required, *optional}, f"members are {', '.join((*required, *optional))}, not {', '.join(w)}")


def _value(w: Any) -> Any:
    _need(len(json.dumps(w, ensure_ascii=False).encode()) <= MAX_VALUE, f"a value has {MAX_VALUE} bytes at most")
    try:
        return from_wire(w)
    except ValueProblem as e:
        raise FilterProblem(str(e)) from e


class _Reader:
    def __init__(self) -> None:
        self.nodes = 0

    def node(self, w: Any, depth: int, element: bool = False) -> Node:
        _need(depth <= MAX_DEPTH, f"filters nest {MAX_DEPTH} deep at most")
        self.nodes += 1
        _need(self.nodes <= MAX_NODES, f"a filter has {MAX_NODES} nodes at most")
        _need(isinstance(w, dict) and isinstance(w.get("op"), str), "a node is an object with an op")
        op = w["op"]
        _need(op in (ELEMENT if element else FIELDS), f"no node {op!r}")
        _members(w, ("op", *(f for f in FIELDS[op] if not (element and f == "path"))))
        path = w.get("path")
        if path is not None:
            check_path(path) if isinstance(path, str) else _need(False, "a path is a string")
        if op == "true":
            return ("true",)
        if op in ("and", "or"):
            _need(isinstance(w["args"], list) and 1 <= len(w["args"]) <= MAX_ITEMS, f"{op} takes 1 to {MAX_ITEMS} nodes")
            return (op, [self.node(x, depth + 1, element) for x in w["args"]])
        if op == "not":
            return ("not", self.node(w["arg"], depth + 1, element))
        if op == "compare":
            _need(w["cmp"] in COMPARE, f"no comparison {w['cmp']!r}")
            v = _value(w["value"])
            return ("not", ("eq", path, v)) if w["cmp"] == "ne" else (w["cmp"], path, v)
        if op in ("in", "nin", "all"):
            _need(isinstance(w["values"], list) and (op == "all") <= len(w["values"]) <= MAX_ITEMS, f"{op} takes a list of {MAX_ITEMS} values at most")
            values = [_value(x) for x in w["values"]]
            if op == "all":
                return ("all", path, _different(values))
            return ("in", path, values) if op == "in" else ("not", ("in", path, values))
        if op == "exists":
            _need(isinstance(w["value"], bool), "exists takes a boolean")
            return ("exists", path) if w["value"] else ("not", ("exists", path))
        if op == "size":
            _need(type(w["size"]) is int and 0 <= w["size"] <= MAX_SIZE, "size takes a whole number")
            return ("size", path, w["size"])
        if op == "type":
            _need(isinstance(w["types"], list) and bool(w["types"]) and all(t in KINDS for t in w["types"]), "type takes names of kinds")
            return ("type", path, [k for k in KINDS if k in w["types"]])
        _need(w["mode"] in ("scalar", "object"), f"no mode {w['mode']!r}")
        return ("elem_scalar" if w["mode"] == "scalar" else "elem", path, self.node(w["arg"], depth + 1, w["mode"] == "scalar"))


def _different(values: list) -> list:
    out: list = []
    for v in values:
        if not any(equal(v, x) for x in out):
            out.append(v)
    return out


def decode_node(w: Any) -> Node:
    return _Reader().node(w, 0)


def encode_node(n: Node) -> dict:
    op, element = n[0], len(n) > 1 and n[1] is None
    at = {} if element else {"path": n[1]} if len(n) > 1 else {}
    if op == "true":
        return {"op": "true"}
    if op in ("and", "or"):
        return {"op": op, "args": [encode_node(x) for x in n[1]]}
    if op == "not":
        x = n[1]
        if x[0] == "eq":
            return encode_node(x) | {"cmp": "ne"}
        if x[0] == "in":
            return encode_node(x) | {"op": "nin"}
        return encode_node(x) | {"value": False} if x[0] == "exists" else {"op": "not", "arg": encode_node(x)}
    if op in COMPARE:
        return {"op": "compare", "cmp": op, **at, "value": to_wire(n[2])}
    if op in ("in", "all"):
        return {"op": op, **at, "values": [to_wire(v) for v in n[2]]}
    if op == "exists":
        return {"op": "exists", **at, "value": True}
    if op == "size":
        return {"op": "size", **at, "size": n[2]}
    if op == "type":
        return {"op": "type", **at, "types": list(n[2])}
    return {"op": "elem_match", **at, "mode": "scalar" if op == "elem_scalar" else "object", "arg": encode_node(n[2])}


def _whole(w: dict, name: str, most: int) -> int | None:
    if name not in w:
        return None
    _need(type(w[name]) is int and 0 <= w[name] <= most, f"{name} is a whole number up to {most}")
    return w[name]


def decode_query(text: str) -> Query:
    w = _parse(text)
    _members(w, ("version", "where"), ("sort", "skip", "limit", "seek"))
    _need(type(w["version"]) is int and w["version"] == 1, "queries have version 1")
    sort = w.get("sort", [])
    _need(isinstance(sort, list), "sort is a list")
    for s in sort:
        _members(s, ("path", "direction"))
        _need(isinstance(s["path"], str) and type(s["direction"]) is int, "a sort field has a path and a direction")
    limit, seek = _whole(w, "limit", MAX_LIMIT), w.get("seek", False)
    _need(isinstance(seek, bool), "seek is a boolean")
    _need(not seek or bool(sort) and limit is not None, "seek needs a sort and a limit")
    return Query(decode_node(w["where"]), tuple((s["path"], s["direction"]) for s in sort), _whole(w, "skip", 2**31) or 0, limit, seek)


def encode_query(q: Query) -> str:
    """Canonical: equal queries have equal texts."""
    w: dict[str, Any] = {"version": 1, "where": encode_node(q.where)}
    if q.sort:
        w["sort"] = [{"path": p, "direction": d} for p, d in q.sort]
    if q.skip:
        w["skip"] = q.skip
    if q.limit is not None:
        w["limit"] = q.limit
    if q.seek:
        w["seek"] = True
    return canonical(w)


def canonical(w: Any) -> str:
    return json.dumps(w, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def decode_mutation(text: str) -> list[tuple[str, str, Any]]:
    """Checked (operator, path, value) in canonical order."""
    from larkdoc.operators.mutations import compile_update

    w = _parse(text)
    _members(w, ("version", "operations"))
    _need(type(w["version"]) is int and w["version"] == 1, "mutations have version 1")
    _need(isinstance(w["operations"], list) and 1 <= len(w["operations"]) <= MAX_ITEMS, "operations are a list")
    ops: dict[str, dict[str, Any]] = {}
    for o in w["operations"]:
        _need(isinstance(o, dict) and o.get("op") in ("set", "unset", "inc", "push", "pull"), "an operation is set, unset, inc, push or pull")
        _members(o, ("op", "path") if o["op"] == "unset" else ("op", "path", "value"))
        _need(isinstance(o["path"], str) and not any(o["path"] in x for x in ops.values()), "a path comes once")
        ops.setdefault("$" + o["op"], {})[o["path"]] = True if o["op"] == "unset" else _value(o["value"])
    return compile_update(ops)


def encode_mutation(plan: list[tuple[str, str, Any]]) -> str:
    return canonical({"version": 1, "operations": [{"op": op[1:], "path": p} | ({} if op == "$unset" else {"value": to_wire(v)}) for op, p, v in plan]})


def decode_document(text: str) -> dict:
    d = _value_any(_parse(text, 16 << 20))
    _need(isinstance(d, dict), "a document is an object")
    return d


def _value_any(w: Any) -> Any:
    try:
        return from_wire(w)
    except ValueProblem as e:
        raise FilterProblem(str(e)) from e


def encode_document(doc: dict) -> str:
    if kind(doc) != "object":
        raise ValueProblem("a document is an object")
    return canonical(to_wire(doc))
