"""Filters and orders as Spark columns over a typed schema.

A path resolves against the schema when the query is compiled, so kinds are known and tests on them
fold to literals; a comparison of one kind stays a plain comparison that reaches the Parquet scan.
Every leaf is two-valued: it is false, never null, where nothing matches. A NULL cell is the value
null; a path outside the schema, or below a NULL struct, is missing."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkdoc.functions.values import RANK, Id, kind


@dataclass
class Ref:
    """A value in a row: its column, type, and whether it is there (None: always)."""

    col: Column
    type: T.DataType
    found: Column | None = None

    @property
    def kind(self) -> str:
        return kind_of(self.type)


def kind_of(t: T.DataType) -> str:
    for types, name in (
        (T.NullType, "null"), (T.BooleanType, "boolean"), (T.IntegralType, "int64"), ((T.FractionalType,), "float64"), (T.StringType, "string"),
        ((T.TimestampType, T.TimestampNTZType, T.DateType), "date"), (T.BinaryType, "binary"), (T.ArrayType, "array"), ((T.StructType, T.MapType), "object"),
    ):
        if isinstance(t, types):
            return name
    raise TypeError(f"no kind for {t.simpleString()}")


def resolve(schema: T.StructType, path: str, root: Column | None = None) -> Ref | None:
    """The value at a dotted path; None if the schema has no such path."""
    ref = Ref(root, schema) if root is not None else None
    found, t = None, schema
    for part in path.split("."):
        if not isinstance(t, T.StructType) or part not in t.names:
            return None
        if ref is not None and (root is None or ref.col is not root):
            found = ref.col.isNotNull()  # a null parent holds nothing
        col = F.col(f"`{part}`") if ref is None else ref.col.getField(part)
        t = t[part].dataType
        ref = Ref(col, t, found)
    return ref


def _and(*cols: Column | None) -> Column:
    return reduce(lambda a, b: a & b, [c for c in cols if c is not None])


def _sure(col: Column, test: Column) -> Column:
    """The test where col isn't NULL, else false. Unlike coalesce() this reaches the Parquet scan."""
    return col.isNotNull() & test


def literal(v: Any, t: T.DataType) -> Column:
    return F.lit(bytes.fromhex(v.hex) if isinstance(v, Id) else v).cast(t)


def equals(ref: Ref, v: Any, member: bool = True) -> Column:
    """Structural equality; with member, an array also equals what one of its elements equals."""
    k, kv = ref.kind, kind(v)
    if k == "array" and kv != "array" and member:
        return _sure(ref.col, F.exists(ref.col, lambda e: equals(Ref(e, ref.type.elementType), v, False)))
    if kv == "null":
        return ref.col.isNull()
    if kv == "array":
        if k != "array":
            return F.lit(False)
        each = [equals(Ref(F.element_at(ref.col, i + 1), ref.type.elementType), x, False) for i, x in enumerate(v)]
        same = F.size(ref.col) == len(v)
        return _sure(ref.col, F.when(same, _and(*each)).otherwise(False) if each else same)
    if kv == "object":
        if not isinstance(ref.type, T.StructType) or set(ref.type.names) != set(v):
            return F.lit(False)
        return _and(ref.col.isNotNull(), *[equals(Ref(ref.col.getField(n), ref.type[n].dataType), x, False) for n, x in v.items()])
    if kv == "id" and k == "binary":
        return _sure(ref.col, ref.col == literal(v, ref.type))
    if RANK[k] != RANK[kv]:
        return F.lit(False)
    if RANK[k] == 2:
        return _number(ref, "eq", v)
    return _sure(ref.col, ref.col == literal(v, T.TimestampNTZType() if k == "date" and not isinstance(ref.type, T.DateType) else ref.type))


def _number(ref: Ref, op: str, v: Any) -> Column:
    """Exact comparison of numbers of either kind, by a bound of the column's own kind. False for NULL."""
    ops = {"eq": Column.__eq__, "gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__}
    if ref.kind == "int64":
        if isinstance(v, float) and v != int(v):
            if op == "eq":
                return F.lit(False)
            op, v = ("gte", math.ceil(v)) if op in ("gt", "gte") else ("lte", math.floor(v))
        v = int(v)
        if not -(2**63) <= v < 2**63:
            beyond = v > 0
            return F.lit(False) if op == "eq" or beyond == (op in ("gt", "gte")) else ref.col.isNotNull()
        return _sure(ref.col, ops[op](ref.col, F.lit(v).cast("long")))
    f = float(v)
    if int(f) != v if isinstance(v, int) else False:  # no double has this value
        if op == "eq":
            return F.lit(False)
        above = int(f) > v
        op = ("gte" if above else "gt") if op in ("gt", "gte") else ("lt" if above else "lte")
    col = ref.col.cast("double") if not isinstance(ref.type, T.DoubleType) else ref.col
    return _sure(ref.col, ops[op](col, F.lit(f)))


def ordered(ref: Ref, op: str, v: Any) -> Column:
    """Range tests across kinds, by rank where kinds differ."""
    k, kv = ref.kind, kind(v)
    if RANK[kv] >= 7:
        return F.lit(False)
    up, also = op in ("gt", "gte"), op in ("gte", "lte")
    if kv == "null":  # everything else that has an order is larger
        rest = ref.col.isNotNull() if up and RANK[k] < 7 else F.lit(False)
        return rest | ref.col.isNull() if also else rest
    null = F.lit(False) if up else ref.col.isNull()
    if RANK[k] >= 7:
        return null
    if RANK[k] != RANK[kv] and not (k == "binary" and kv == "id"):
        return (ref.col.isNotNull() if (RANK[k] > RANK[kv]) == up else F.lit(False)) | null
    if RANK[k] == 2:
        got = _number(ref, op, v)
    else:
        x = literal(v, T.TimestampNTZType() if k == "date" and not isinstance(ref.type, T.DateType) else ref.type)
        got = _sure(ref.col, {"gt": ref.col > x, "gte": ref.col >= x, "lt": ref.col < x, "lte": ref.col <= x}[op])
    return got if up else got | null


def predicate(n: tuple, schema: T.StructType, here: Ref | None = None) -> Column:
    """A filter as a two-valued column. here: the element that paths, or the path None, start from."""
    op = n[0]
    if op == "true":
        return F.lit(True)
    if op in ("and", "or"):
        parts = [predicate(x, schema, here) for x in n[1]]
        return reduce(lambda a, b: a & b if op == "and" else a | b, parts)
    if op == "not":
        return ~predicate(n[1], schema, here)
    if n[1] is None:
        ref = here
    elif here is not None:
        ref = resolve(here.type, n[1], here.col) if isinstance(here.type, T.StructType) else None
    else:
        ref = resolve(schema, n[1])
    if ref is None:
        return F.lit(False)
    got = _leaf(op, ref, n[2] if len(n) > 2 else None, schema)
    return got if ref.found is None else ref.found & got


def _leaf(op: str, ref: Ref, v: Any, schema: T.StructType) -> Column:
    if op == "exists":
        return F.lit(True)
    if op == "eq":
        return equals(ref, v)
    if op == "in":
        return _in(ref, v)
    if op in ("gt", "gte", "lt", "lte"):
        return ordered(ref, op, v)
    if op == "type":
        rest = ref.col.isNotNull() if ref.kind in v else F.lit(False)
        return rest | ref.col.isNull() if "null" in v else rest
    if ref.kind != "array":
        return F.lit(False)
    element = ref.type.elementType
    if op == "size":
        return _sure(ref.col, F.size(ref.col) == v)
    if op == "all":
        return _sure(ref.col, _and(*[_some(ref.col, element, x) for x in v]))
    if op == "elem":
        if not isinstance(element, T.StructType):
            return F.lit(False)
        return _sure(ref.col, F.exists(ref.col, lambda e: e.isNotNull() & predicate(v, schema, Ref(e, element))))
    return _sure(ref.col, F.exists(ref.col, lambda e: predicate(v, schema, Ref(e, element))))


def _some(col: Column, element: T.DataType, x: Any) -> Column:
    return F.exists(col, lambda e: equals(Ref(e, element), x, False))


def _in(ref: Ref, values: list) -> Column:
    """One IN list where all values are of the column's own kind, so that it reaches the scan."""
    plain = [v for v in values if ref.kind in ("string", "int64", "boolean") and kind(v) == ref.kind]
    rest = [equals(ref, v) for v in values if not any(v is p for p in plain)]
    if plain:
        rest.append(_sure(ref.col, ref.col.isin(plain)))
    return reduce(lambda a, b: a | b, rest) if rest else F.lit(False)


def ordering(schema: T.StructType, sort: tuple, position: list[str]) -> list[Column]:
    """Sort columns: missing, then null, then values going up, the reverse going down; ties by position."""
    out = []
    for path, d in sort:
        ref = resolve(schema, path)
        if ref is None:
            continue  # missing in every row
        if ref.found is not None:
            out.append(ref.found.asc() if d > 0 else ref.found.desc())
        key = ref.col.isNotNull() if RANK[ref.kind] >= 7 else ref.col
        out.append(key.asc_nulls_first() if d > 0 else key.desc_nulls_last())
    return out + [F.col(f"`{p}`").asc() for p in position]


def projection(schema: T.StructType, keep: list[str]) -> list[Column]:
    """The columns of some dotted paths, nested structs rebuilt; absent paths are dropped."""
    tree: dict = {}
    for path in keep:
        at = tree
        for part in path.split("."):
            at = at.setdefault(part, {})
        at["*"] = {}

    def build(t: T.StructType, col: Column | None, want: dict) -> list[Column]:
        out = []
        for f in t.fields:
            if f.name not in want:
                continue
            c, sub = (F.col(f"`{f.name}`") if col is None else col.getField(f.name)), want[f.name]
            if "*" in sub:
                out.append(c.alias(f.name))
            elif isinstance(f.dataType, T.StructType) and (inner := build(f.dataType, c, sub)):
                out.append(F.when(c.isNotNull(), F.struct(*inner)).alias(f.name))
        return out

    return build(schema, None, tree)
