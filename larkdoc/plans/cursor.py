"""Page cursors: the sort values of a page's last row as URL-safe text."""

from __future__ import annotations

import base64
import json
import re
from typing import Any

from larkdoc.functions.evaluate import lookup
from larkdoc.functions.values import ValueProblem, from_wire, kind, strict_json, to_wire

from .filters import FilterProblem, Node, continuation

MAX_CHARACTERS = 16_384


def page_sort(sort: list[tuple[str, int]], key: str = "_id") -> list[tuple[str, int]]:
    """The sort with the key behind it, so that rows have one order."""
    if not sort or len({p for p, _ in sort}) != len(sort):
        raise FilterProblem("a page needs a sort of different fields")
    return list(sort) if any(p == key for p, _ in sort) else [*sort, (key, 1)]


def cursor_for(row: dict, sort: list[tuple[str, int]], key: str = "_id") -> str:
    values: list[Any] = []
    for p, _ in page_sort(sort, key):
        found, v = lookup(row, p)
        if found and kind(v) in ("array", "object"):
            raise FilterProblem(f"{p} holds no scalar")
        values.append(to_wire(v) if found else {"missing": True})
    text = json.dumps({"version": 1, "sort": [{"path": p, "direction": d} for p, d in page_sort(sort, key)], "values": values}, separators=(",", ":"), ensure_ascii=False)
    out = base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")
    if len(out) > MAX_CHARACTERS:
        raise FilterProblem("the cursor exceeds its limit")
    return out


def values_after(cursor: str, sort: list[tuple[str, int]], key: str = "_id") -> dict:
    """The row values a cursor stands for; a path that isn't there was missing."""
    try:
        if not re.fullmatch(r"[A-Za-z0-9_-]+", cursor) or len(cursor) > MAX_CHARACTERS:
            raise ValueError(cursor)
        w = strict_json(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)).decode())
        if w["version"] != 1 or set(w) != {"version", "sort", "values"}:
            raise ValueError(cursor)
        given = [(s["path"], s["direction"]) for s in w["sort"]]
        values = [None if x == {"missing": True} else (from_wire(x),) for x in w["values"]]
    except (ValueError, KeyError, TypeError, ValueProblem) as e:
        raise FilterProblem("the cursor is malformed") from e
    if given != page_sort(sort, key) or len(values) != len(given):
        raise FilterProblem("the cursor belongs to another sort")
    return {p: v[0] for (p, _), v in zip(given, values, strict=True) if v is not None}


def filter_after(cursor: str, sort: list[tuple[str, int]], key: str = "_id") -> Node:
    return continuation(page_sort(sort, key), values_after(cursor, sort, key))


def next_cursor(rows: list[dict], sort: list[tuple[str, int]], key: str = "_id") -> str | None:
    """That of the last row; none for an empty page."""
    return cursor_for(rows[-1], sort, key) if rows else None
