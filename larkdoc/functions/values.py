"""The value model: ten kinds, their total order, equality, and the tagged JSON form."""

from __future__ import annotations

import base64
import datetime as dt
import json
import re
from dataclasses import dataclass
from fractions import Fraction
from functools import cmp_to_key
from typing import Any

RANK = {"null": 0, "boolean": 1, "int64": 2, "float64": 2, "string": 3, "date": 4, "id": 5, "binary": 6, "array": 7, "object": 8}
KINDS = tuple(RANK)
I64 = (-(2**63), 2**63 - 1)


class ValueProblem(ValueError):
    """A value or field name outside the model."""


@dataclass(frozen=True)
class Id:
    """A 16-byte document id, written as 32 lower-case hex digits."""

    hex: str

    def __post_init__(self) -> None:
        if len(self.hex) != 32 or set(self.hex) - set("0123456789abcdef") or not int(self.hex, 16):
            raise ValueProblem(f"not a document id: {self.hex!r}")


def kind(v: Any) -> str:
    if v is None:
        return "null"
    for types, name in ((bool, "boolean"), (int, "int64"), (float, "float64"), (str, "string"), (dt.datetime, "date"), (Id, "id"), ((bytes, bytearray), "binary"), ((list, tuple), "array"), (dict, "object")):
        if isinstance(v, types):
            if name == "int64" and not I64[0] <= v <= I64[1]:
                raise ValueProblem("an integer beyond 64 bits")
            if name == "float64" and v - v != 0:
                raise ValueProblem("a float that isn't finite")
            return name
    raise ValueProblem(f"no kind for {type(v).__name__}")


def check_field(name: str) -> None:
    if not isinstance(name, str) or not name or "\x00" in name or "." in name or name.startswith("$") or name in ("__proto__", "prototype", "constructor"):
        raise ValueProblem(f"not a field name: {name!r}")


def check_path(path: str) -> list[str]:
    if not isinstance(path, str) or len(path.encode()) > 512:
        raise ValueProblem("a path has 512 bytes at most")
    parts = path.split(".")
    for p in parts:
        check_field(p)
    return parts


def equal(a: Any, b: Any) -> bool:
    """Structural; integers and floats compare by exact value."""
    ka, kb = kind(a), kind(b)
    if RANK[ka] != RANK[kb]:
        return False
    if ka == "array":
        return len(a) == len(b) and all(map(equal, a, b))
    if ka == "object":
        return a.keys() == b.keys() and all(equal(v, b[k]) for k, v in a.items())
    return Fraction(a) == Fraction(b) if RANK[ka] == 2 else a == b


def compare(a: Any, b: Any) -> int:
    """The total order; arrays tie with arrays, objects with objects."""
    ka, kb = kind(a), kind(b)
    if RANK[ka] != RANK[kb]:
        return -1 if RANK[ka] < RANK[kb] else 1
    if ka in ("null", "array", "object"):
        return 0
    if RANK[ka] == 2:
        a, b = Fraction(a), Fraction(b)
    elif ka == "string":
        a, b = a.encode(), b.encode()
    elif ka == "id":
        a, b = a.hex, b.hex
    return (a > b) - (a < b)


order_key = cmp_to_key(compare)

TAGS = {"null": "null", "boolean": "bool", "int64": "int64", "float64": "number", "string": "string", "date": "date", "id": "id", "binary": "binary", "array": "array", "object": "object"}
_KIND = {t: k for k, t in TAGS.items()}


def to_wire(v: Any) -> dict:
    k = kind(v)
    payload = {
        "int64": str, "date": lambda x: x.strftime("%Y-%m-%dT%H:%M:%S.") + f"{x.microsecond // 1000:03d}Z", "id": lambda x: x.hex,
        "binary": lambda x: base64.b64encode(x).decode(), "array": lambda x: [to_wire(e) for e in x], "object": lambda x: [[n, to_wire(x[n])] for n in sorted(x, key=str.encode)],
    }.get(k, lambda x: x)
    return {"t": TAGS[k]} | ({"v": payload(v)} if k != "null" else {})


def from_wire(w: dict) -> Any:
    if not isinstance(w, dict) or w.get("t") not in _KIND or set(w) != ({"t"} if w["t"] == "null" else {"t", "v"}):
        raise ValueProblem("not a tagged value")
    k, v = _KIND[w["t"]], w.get("v")
    want = {"boolean": bool, "float64": (int, float), "array": list, "object": list}.get(k, str)
    if k == "null":
        return None
    if not isinstance(v, want) or k == "float64" and isinstance(v, bool):
        raise ValueProblem(f"a {k} can't be {v!r}")
    if k == "int64":
        n = int(v) if v.lstrip("-").isascii() and v.lstrip("-").isdigit() else 0
        if str(n) != v or not I64[0] <= n <= I64[1]:
            raise ValueProblem("not a canonical 64-bit integer")
        return n
    if k == "date":
        try:
            t = dt.datetime.strptime(v, "%Y-%m-%dT%H:%M:%S.%fZ")
        except ValueError as e:
            raise ValueProblem(f"no date {v!r}") from e
        if to_wire(t)["v"] != v:
            raise ValueProblem("a date has milliseconds")
        return t
    if k == "array":
        return [from_wire(e) for e in v]
    if k == "object":
        if any(not isinstance(x, list) or len(x) != 2 or not isinstance(x[0], str) for x in v):
            raise ValueProblem("an object is a list of pairs")
        out = {n: from_wire(x) for n, x in v}
        for n in out:
            check_field(n)
        if len(out) != len(v):
            raise ValueProblem("a field appears twice")
        return out
    if k == "binary":
        try:
            raw = base64.b64decode(v, validate=True)
        except ValueError as e:
            raise ValueProblem("not base64") from e
        return raw
    if k == "float64":
        kind(float(v))  # finite
    return {"float64": float, "id": Id}.get(k, lambda x: x)(v)


def strict_json(text: str, depth: int = 128) -> Any:
    """JSON without repeated names, trailing data or special numbers, nested so deep at most."""
    level = 0
    for x in re.finditer(r'"(?:[^"\\]|\\.)*"|[\[{]|[\]}]', text):
        level += {"[": 1, "{": 1, "]": -1, "}": -1}.get(x[0], 0)
        if level > depth:
            raise ValueProblem(f"JSON nests {depth} deep at most")

    def once(pairs: list) -> dict:
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueProblem("a name appears twice")
        return dict(pairs)

    def never(x: str) -> None:
        raise ValueProblem(f"{x} is no JSON number")

    return json.loads(text, object_pairs_hook=once, parse_constant=never)
