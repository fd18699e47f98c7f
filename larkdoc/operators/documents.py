"""Collections whose documents have no schema: (_id, _pos, doc VARIANT).

Fields may hold different kinds in different documents, and a missing field differs from null. Every
extraction is guarded by a test of the value's kind; every leaf of a filter is two-valued. Values are
compared by a key (rank, number as double and exact rest, string, bytes), so ranges and orders across
kinds are plain comparisons of structs in the JVM."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkdoc.functions import jsondoc, mutate
from larkdoc.functions.values import RANK, Id, ValueProblem, kind
from larkdoc.plans.cursor import page_sort, values_after
from larkdoc.plans.filters import FilterProblem, Node, Query, compile_filter, continuation, query

from .collection import MAX_GROUPS, LimitReached, without_first

SCHEMA = "_id string, _pos long, doc variant"
_TWO63 = float(2**63)


def at(v: Column, path: str) -> Column:
    """The value at a dotted path, objects only: SQL NULL where it is missing, a VARIANT null where it is null."""
    steps = "".join("[{}]".format(f'"{p}"' if '"' not in p else f"'{p}'") for p in path.split("."))
    return F.try_variant_get(v, "$" + steps, "variant")


def _get(v: Column, t: str) -> Column:
    return F.try_variant_get(v, "$", t)


def kind_column(v: Column) -> Column:
    """The name of the value's kind; NULL where it is missing."""
    s = F.schema_of_variant(v)
    out = F.when(v.isNull(), F.lit(None).cast("string")).when(F.is_variant_null(v), "null")
    for name, prefix in (("boolean", "BOOLEAN"), ("int64", "BIGINT"), ("float64", "DOUBLE"), ("string", "STRING"), ("array", "ARRAY")):
        out = out.when(s.startswith(prefix), name)
    for name, prefix in (("date", "OBJECT<`$date`"), ("id", "OBJECT<`$id`"), ("binary", "OBJECT<`$binary`"), ("object", "OBJECT"), ("binary", "BINARY"), ("date", "TIMESTAMP"), ("date", "DATE"), ("float64", "")):
        out = out.when(s.startswith(prefix), name)
    return out


def _key(rank: Any, d: Any = 0.0, r: Any = 0, s: Any = "", x: Any = b"") -> Column:
    cols = [c if isinstance(c, Column) else F.lit(c) for c in (rank, d, r, s, x)]
    return F.struct(*[F.coalesce(c.cast(t), F.lit(z).cast(t)).alias(n) for c, n, t, z in zip(cols, "kdrsx", ("int", "double", "bigint", "string", "binary"), (0, 0.0, 0, "", b""), strict=True)])


def key_column(v: Column) -> Column:
    """The value's place in the total order; arrays tie with arrays and objects with objects. NULL where it is missing."""
    k, i = kind_column(v), _get(v, "bigint")
    d = i.cast("double")
    rest = F.when(d >= _TWO63, (i - F.lit(2**63 - 1)) - F.lit(1)).when(d.isNotNull(), i - F.when(d < _TWO63, d).cast("long"))
    stamp = F.coalesce(F.try_variant_get(v, "$['$date']", "bigint"), F.unix_millis(_get(v, "timestamp")))
    whole = F.try_variant_get(v, "$['$id']", "string")
    raw = F.coalesce(F.unbase64(F.try_variant_get(v, "$['$binary']", "string")), _get(v, "binary"))
    return (
        F.when(v.isNull(), F.lit(None).cast("struct<k:int,d:double,r:bigint,s:string,x:binary>")).when(k == "null", _key(0)).when(k == "boolean", _key(1, _get(v, "boolean").cast("double")))
        .when(k == "int64", _key(2, d, rest)).when(k == "float64", _key(2, _get(v, "double") + F.lit(0.0))).when(k == "string", _key(3, s=_get(v, "string")))
        .when(k == "date", _key(4, r=stamp)).when(k == "id", _key(5, s=whole)).when(k == "binary", _key(6, x=raw)).when(k == "array", _key(7)).otherwise(_key(8))
    )


def key_literal(x: Any) -> Column:
    k = kind(x)
    if RANK[k] == 2:
        d = float(x)
        return _key(2, d + 0.0, x - int(d) if k == "int64" else 0)
    if k == "date":
        return _key(4, r=jsondoc.millis(x))
    return {"null": lambda: _key(0), "boolean": lambda: _key(1, float(x)), "string": lambda: _key(3, s=x), "id": lambda: _key(5, s=x.hex), "binary": lambda: _key(6, x=bytes(x))}.get(k, lambda: _key(RANK[k]))()


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def equals(v: Column, x: Any, member: bool = True) -> Column:
    """Structural equality; with member, an array also equals what one of its elements equals."""
    k = kind(x)
    if k == "array":
        items = _get(v, "array<variant>")
        same = [equals(F.get(items, F.lit(i)), e, False) for i, e in enumerate(x)]
        return _sure((kind_column(v) == "array") & (F.size(items) == len(x)) & reduce(lambda a, b: a & b, same, F.lit(True)))
    if k == "object":
        names = F.map_keys(_get(v, "map<string,variant>"))
        same = [equals(at(v, n), e, False) for n, e in x.items()]
        whole = _sure((kind_column(v) == "object") & (F.size(names) == len(x)) & reduce(lambda a, b: a & b, same, F.lit(True)))
        return whole | _sure(_some(_get(v, "array<variant>"), x)) if member else whole
    plain = _sure(key_column(v) == key_literal(x))
    return plain | _sure(F.exists(_get(v, "array<variant>"), lambda e: _sure(key_column(e) == key_literal(x)))) if member else plain


def _some(items: Column, x: Any) -> Column:
    return F.exists(items, lambda e: equals(e, x, False))


def predicate(n: Node, v: Column) -> Column:
    """A filter over the document, or element, v as a two-valued column."""
    op = n[0]
    if op == "true":
        return F.lit(True)
    if op in ("and", "or"):
        return reduce(lambda a, b: a & b if op == "and" else a | b, [predicate(x, v) for x in n[1]])
    if op == "not":
        return ~predicate(n[1], v)
    ref = v if n[1] is None else at(v, n[1])
    if op == "exists":
        return ref.isNotNull()
    x = n[2]
    if op == "eq":
        return equals(ref, x)
    if op == "in":
        return reduce(lambda a, b: a | b, [equals(ref, e) for e in x], F.lit(False))
    if op in ("gt", "gte", "lt", "lte"):
        if RANK[kind(x)] >= 7:
            return F.lit(False)
        key, lit = key_column(ref), key_literal(x)
        return _sure((key["k"] < 7) & {"gt": key > lit, "gte": key >= lit, "lt": key < lit, "lte": key <= lit}[op])
    if op == "type":
        return _sure(kind_column(ref).isin(list(x)))
    items = F.when(kind_column(ref) == "array", _get(ref, "array<variant>"))
    if op == "size":
        return _sure(F.size(items) == x)
    if op == "all":
        return reduce(lambda a, b: a & b, [_sure(_some(items, w)) for w in x])
    if op == "elem":
        return _sure(F.exists(items, lambda e: (kind_column(e) == "object") & predicate(x, e)))
    return _sure(F.exists(items, lambda e: predicate(x, e)))


def ordering(sort: Iterable[tuple[str, int]], v: Column) -> list[Column]:
    """Missing, then values by rank going up, the reverse going down; ties by position."""
    out = []
    for path, d in sort:
        key = F.col("_id") if path == "_id" else key_column(at(v, path))
        out.append(key.asc_nulls_first() if d > 0 else key.desc_nulls_last())
    return [*out, F.col("_pos").asc()]


def project(v: Column, keep: list[str]) -> Column:
    """The document with some dotted paths only; absent paths, and objects left empty, go."""
    tree: dict = {}
    for path in keep:
        here = tree
        for part in path.split("."):
            here = here.setdefault(part, {})
        here[""] = {}

    def build(here: Column, want: dict) -> Column:
        parts = []
        for name, sub in want.items():
            x = at(here, name)
            parts.append(F.struct(F.lit(name).alias("key"), (x if "" in sub else F.when(kind_column(x) == "object", build(x, sub))).alias("value")))
        fields = F.filter(F.array(*parts), lambda p: p["value"].isNotNull())
        return F.when(F.size(fields) > 0, F.to_variant_object(F.map_from_entries(fields)))

    return build(v, tree) if tree else F.lit(None).cast("variant")


@dataclass(frozen=True)
class Documents:
    """Reads of a schemaless collection. All lazy."""

    df: DataFrame

    def where(self, n: Node) -> DataFrame:
        return self.df.where(predicate(n, F.col("doc")))

    def run(self, q: Query, keep: list[str] | None = None) -> DataFrame:
        got, order = self.where(q.where), ordering(q.sort, F.col("doc"))
        if q.skip and q.limit is None:
            got = without_first(got, order, q.skip, ["_pos"])
            got = got.orderBy(*order) if q.sort else got
        elif q.sort or q.limit is not None:
            got = got.orderBy(*order)
            got = got.offset(q.skip) if q.skip else got
            got = got.limit(q.limit) if q.limit is not None else got
        return got if keep is None else got.withColumn("doc", project(F.col("doc"), ["_id", *keep]))

    def find(self, f: dict | None = None, sort=(), skip: int = 0, limit: int | None = None, keep: list[str] | None = None) -> DataFrame:
        return self.run(query(f, sort, skip, limit), keep)

    def find_one(self, f: dict | None = None) -> dict:
        """The first match in insertion order as a plain document; an error where there is none."""
        got = as_documents(self.find(f, limit=1))
        if not got:
            raise NotFound("no document matches")
        return got[0]

    def by_id(self, *ids: str) -> DataFrame:
        """Lookup by id on the plain column, so that it reaches the scan."""
        return self.df.where(F.col("_id").isin(list(ids)))

    def count(self, f: dict | None = None, most: int | None = None) -> DataFrame:
        got = self.where(compile_filter(f or {})).select(F.lit(1).alias("one"))
        if most is None:
            return got.agg(F.count("*").alias("count"))
        return got.limit(most).agg(F.count("*").alias("count")).withColumn("capped", F.col("count") == most)

    def group_count(self, field: str, f: dict | None = None, most: int | None = None, max_groups: int | None = MAX_GROUPS) -> DataFrame:
        """(kind, key as JSON, count): groups by the stored form, so 1 and 1.0 are two groups; missing counts as null."""
        if "." in field:
            raise FilterProblem("a grouped field has no dots")
        got = self.where(compile_filter(f or {}))
        if most is not None:
            got = got.orderBy("_pos").limit(most)
        v = at(F.col("doc"), field)
        got = got.select(F.coalesce(kind_column(v), F.lit("null")).alias("kind"), F.coalesce(F.to_json(v), F.lit("null")).alias("key")).groupBy("kind", "key").agg(F.count("*").alias("count"))
        if max_groups is None:
            return got
        over = got.limit(max_groups + 1).agg(F.count("*").alias("n")).select(F.when(F.col("n") > max_groups, F.raise_error(F.lit(f"over {max_groups} groups"))).alias("over"))
        return got.join(F.broadcast(over), F.lit(True), "left").where(F.col("over").isNull()).drop("over")

    def page(self, sort: list[tuple[str, int]], first: int, after: str | None = None, f: dict | None = None) -> DataFrame:
        """Keyset pagination; after is a cursor made from the last row of the page before."""
        full = page_sort(sort)
        q = query(f, full, 0, first)
        return self.run(q if after is None else q.constrain(continuation(full, values_after(after, sort))))


class NotFound(LookupError):
    """No document where one was asked for."""


def as_documents(df: DataFrame) -> list[dict]:
    """The rows on the driver; for windows and results whose size is bounded."""
    return [jsondoc.from_text(r[0]) for r in df.select(F.to_json("doc")).collect()]


def load(spark: SparkSession, docs: list[dict], first: int = 0) -> DataFrame:
    """Plain documents as a collection; those without _id get a random one."""
    return texts(spark.createDataFrame([(_id_of(d), first + i, jsondoc.to_text(d | {"_id": Id(_id_of(d))} if isinstance(d.get("_id"), Id) else d)) for i, d in enumerate(map(with_id, docs))], "_id string, _pos long, text string"))


def with_id(d: dict) -> dict:
    import uuid

    return d if "_id" in d else {"_id": Id(uuid.uuid4().hex), **d}


def _id_of(d: dict) -> str:
    i = d["_id"]
    if not isinstance(i, (Id, str)):
        raise ValueProblem("an _id is an id")
    return i.hex if isinstance(i, Id) else i


def texts(df: DataFrame) -> DataFrame:
    """(_id, _pos, text) -> (_id, _pos, doc)."""
    return df.select("_id", "_pos", F.parse_json("text").alias("doc"))


def from_rows(df: DataFrame, key: str, position: Column | None = None) -> DataFrame:
    """A typed DataFrame as schemaless documents: columns become fields, the key as text also _id; NULL cells are null."""
    fields = F.to_variant_object(F.struct(F.col(key).cast("string").alias("_id"), *[c for c in df.columns if c != "_id"]))
    return df.select(F.col(key).cast("string").alias("_id"), (position if position is not None else F.col(key)).cast("long").alias("_pos"), fields.alias("doc"))


def from_json(df: DataFrame, key: str, text: str) -> DataFrame:
    """Documents from a column of JSON text; rows that aren't JSON objects fail."""
    return df.select(F.col(key).cast("string").alias("_id"), F.col(key).cast("long").alias("_pos"), F.parse_json(text).alias("doc"))


def images(df: DataFrame, plan: list[tuple[str, str, Any]]) -> DataFrame:
    """(_id, _pos, doc) -> (_id, _pos, before, after, modified, error): what a compiled update makes of every row, as JSON texts."""

    @F.pandas_udf("after string, modified boolean, error string")
    def run(before: pd.Series) -> pd.DataFrame:
        out = []
        for t in before:
            try:
                d = jsondoc.from_text(t)
                new = mutate.apply(d, plan)
                out.append((jsondoc.to_text(new), mutate.modified(d, new), None))
            except ValueProblem as e:
                out.append((None, False, str(e)))
        return pd.DataFrame(out, columns=["after", "modified", "error"])

    got = df.select("_id", "_pos", F.to_json("doc").alias("before"))
    return got.withColumn("x", run("before")).select("_id", "_pos", "before", "x.after", "x.modified", "x.error")


def selected(df: DataFrame, n: Node, one: bool = False, most: int | None = None) -> DataFrame:
    """The rows a mutation applies to: all matches, or the first in insertion order. Over `most` matches it is refused as a whole."""
    got = Documents(df).where(n)
    if one:
        return got.orderBy("_pos").limit(1)
    if most is not None:
        if most <= 0:
            raise LimitReached("the bound of a mutation is positive")
        if got.select("_id").limit(most + 1).count() > most:
            raise LimitReached(f"the mutation matches over {most} documents")
    return got
