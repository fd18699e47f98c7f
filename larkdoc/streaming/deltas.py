"""Ordered deltas between two snapshots of a view, and their application.

Where two snapshots have the same ids in the same order a delta has changes only. Else its operations are,
in order: remove (old order), then from the new order's end to its beginning add_before or move_before,
each naming the row it goes in front of (None: the end), and each kept row's change right behind its
place. Snapshots are (token, [(id, row)]); views hold a bounded number of rows, so this runs on the driver."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from larkdoc.functions.values import ValueProblem, equal

Snapshot = tuple[int, list[tuple[Any, Any]]]


class DeltaProblem(ValueError):
    """A delta that doesn't fit its snapshot."""


@dataclass(frozen=True)
class Delta:
    from_token: int
    token: int
    operations: tuple[tuple, ...]  # (kind, id, before, row)


class _Order:
    """A doubly linked list of ids; None is the end."""

    def __init__(self, ids: list) -> None:
        self.after: dict = {}
        self.ahead: dict = {None: None}
        for i in ids:
            self.put(i, None)

    def put(self, i: Any, before: Any) -> None:
        last = self.ahead[before]
        self.after[i], self.ahead[i], self.ahead[before] = before, last, i
        if last is not None:
            self.after[last] = i

    def take(self, i: Any) -> None:
        before, behind = self.ahead.pop(i), self.after.pop(i)
        self.ahead[behind] = before
        if before is not None:
            self.after[before] = behind

    def ids(self) -> list:
        out, i = [], self.ahead[None]
        while i is not None:
            out.append(i)
            i = self.ahead[i]
        return out[::-1]


def _ids(rows: list[tuple[Any, Any]]) -> list:
    ids = [i for i, _ in rows]
    if None in ids or len(set(ids)) != len(ids):
        raise DeltaProblem("a snapshot has one id for every row")
    return ids


def same(a: Any, b: Any) -> bool:
    """Equal as documents, where they are some: 1 and 1.0 are equal."""
    try:
        return equal(a, b)
    except ValueProblem:
        return a == b


def build(old: Snapshot, new: Snapshot) -> Delta:
    before, after, a, b = dict(old[1]), dict(new[1]), _ids(old[1]), _ids(new[1])
    if a == b:
        return Delta(old[0], new[0], tuple(("change", i, None, after[i]) for i in b if not same(before[i], after[i])))
    ops: list[tuple] = [("remove", i, None, None) for i in a if i not in after]
    order, anchor = _Order([i for i in a if i in after]), None
    for i in reversed(b):
        if i not in before:
            ops.append(("add_before", i, anchor, after[i]))
            order.put(i, anchor)
        else:
            if order.after[i] != anchor:
                ops.append(("move_before", i, anchor, None))
                order.take(i)
                order.put(i, anchor)
            if not same(before[i], after[i]):
                ops.append(("change", i, None, after[i]))
        anchor = i
    return Delta(old[0], new[0], tuple(ops))


def apply(snapshot: Snapshot, d: Delta) -> Snapshot:
    """The snapshot after the delta, which must fit it exactly; the one given stays as it is."""
    token, rows = snapshot
    if token != d.from_token or d.token <= d.from_token or not d.operations:
        raise DeltaProblem("the tokens don't follow")
    order, held = _Order(_ids(rows)), dict(rows)
    for kind, i, before, row in d.operations:
        if i is None or before is not None and (before == i or before not in held):
            raise DeltaProblem("no such anchor")
        if (kind == "add_before") == (i in held):
            raise DeltaProblem("a row is, or isn't, there")
        if kind in ("remove", "change") and before is not None or kind in ("remove", "move_before") and row is not None or kind in ("add_before", "change") and row is None:
            raise DeltaProblem(f"{kind} has other members")
        if kind == "remove":
            order.take(i)
            del held[i]
        elif kind == "change":
            held[i] = row
        elif kind == "add_before":
            held[i] = row
            order.put(i, before)
        elif kind == "move_before":
            if order.after[i] == before:
                raise DeltaProblem("a move moves")
            order.take(i)
            order.put(i, before)
        else:
            raise DeltaProblem(f"no operation {kind}")
    return d.token, [(i, held[i]) for i in order.ids()]
