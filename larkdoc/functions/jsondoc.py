"""Documents as the JSON text that becomes and comes from a VARIANT.

Integers are plain; floats carry an exponent, so that they are read as DOUBLE; dates, ids and binary
values are objects of one reserved name each, which no field of a document can have."""

from __future__ import annotations

import base64
import datetime as dt
import json
import re
from typing import Any

from .values import Id, ValueProblem, check_field, kind

EPOCH = dt.datetime(1970, 1, 1)
DATE, ID, BINARY = "$date", "$id", "$binary"
_DEPTH = 64


def millis(t: dt.datetime) -> int:
    """Whole milliseconds since 1970 UTC."""
    t = t.astimezone(dt.timezone.utc).replace(tzinfo=None) if t.tzinfo else t
    return (t - EPOCH) // dt.timedelta(milliseconds=1)


def _text(v: Any, depth: int) -> str:
    k = kind(v)
    if depth > _DEPTH:
        raise ValueProblem(f"documents nest {_DEPTH} deep at most")
    if k == "float64":
        s = repr(v)
        return s if "e" in s else s + "e0"
    if k == "date":
        return f'{{"{DATE}":{millis(v)}}}'
    if k == "id":
        return f'{{"{ID}":"{v.hex}"}}'
    if k == "binary":
        return f'{{"{BINARY}":"{base64.b64encode(v).decode()}"}}'
    if k == "array":
        return "[" + ",".join(_text(e, depth + 1) for e in v) + "]"
    if k == "object":
        for n in v:
            check_field(n)
        return "{" + ",".join(f"{json.dumps(n)}:{_text(v[n], depth + 1)}" for n in sorted(v, key=str.encode)) + "}"
    return json.dumps(v)


def to_text(doc: Any) -> str:
    return _text(doc, 0)


def _object(pairs: list[tuple[str, Any]]) -> Any:
    d = dict(pairs)
    if len(d) == 1:
        (n, v), = d.items()
        if n == DATE:
            return EPOCH + dt.timedelta(milliseconds=v)
        if n == ID:
            return Id(v)
        if n == BINARY:
            return base64.b64decode(v)
    return d


def _number(s: str) -> Any:
    return float(s)


def from_text(text: str) -> Any:
    return json.loads(re.sub(r"^﻿", "", text), object_pairs_hook=_object, parse_float=_number)
