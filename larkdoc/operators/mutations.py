"""Inserts, updates and deletes as DataFrame transforms: before image in, after image out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkdoc.functions.values import check_path, kind
from larkdoc.plans.filters import FilterProblem, compile_filter

from .lowering import Ref, equals, kind_of, literal, predicate, resolve

OPERATORS = ("$inc", "$pull", "$push", "$set", "$unset")


class MutationProblem(FilterProblem):
    """An update that the language or the schema doesn't allow."""


def compile_update(ops: dict, key: str = "_id") -> list[tuple[str, str, object]]:
    """Checked (operator, path, value), in canonical order. Paths may not meet and the key doesn't change."""
    out, seen = [], []
    for op in sorted(ops):
        if op not in OPERATORS or not isinstance(ops[op], dict) or not ops[op]:
            raise MutationProblem(f"no update {op!r}")
        for path in sorted(ops[op]):
            parts = check_path(path)
            if parts[0] in ("_id", key):
                raise MutationProblem("the id doesn't change")
            if any(p == parts[: len(p)] or parts == p[: len(parts)] for p in seen):
                raise MutationProblem(f"{path} meets another path")
            seen.append(parts)
            v = ops[op][path]
            if op == "$inc" and kind(v) not in ("int64", "float64"):
                raise MutationProblem("$inc takes a number")
            out.append((op, path, v))
    return out


def _changed(op: str, ref: Ref, v) -> tuple[Column, Column | None]:
    """The value after an operation, and whether the row doesn't allow it. A NULL cell is the value null."""
    if op == "$unset":
        return F.lit(None).cast(ref.type), None
    if op == "$set":
        if v is not None and kind_of(ref.type) != kind(v) and {kind_of(ref.type), kind(v)} != {"int64", "float64"}:
            raise MutationProblem(f"a column of {ref.type.simpleString()} can't hold {kind(v)}")
        if kind_of(ref.type) == "int64" and kind(v) == "float64" and v != int(v):
            raise MutationProblem("an integer column can't hold the value")
        new = F.lit(None).cast(ref.type) if v is None else F.array(*map(F.lit, v)).cast(ref.type) if isinstance(v, list) else literal(v, ref.type)
        # a value that equals the old one is no change, of whatever kind of number
        return new, None
    if op == "$inc":
        if kind_of(ref.type) not in ("int64", "float64"):
            raise MutationProblem("$inc needs a number")
        if kind_of(ref.type) == "int64" and kind(v) == "float64":
            raise MutationProblem("an integer column can't hold the sum")
        total = F.try_add(ref.col, F.lit(v).cast(ref.type))
        bad = total.isNull() if kind_of(ref.type) == "int64" else total.isNull() | F.isnan(total) | (F.abs(total) == float("inf"))
        return total, bad
    if not isinstance(ref.type, T.ArrayType):
        raise MutationProblem(f"{op} needs an array")
    element = ref.type.elementType
    if op == "$push":
        return F.concat(ref.col, F.array(literal(v, element))), ref.col.isNull()
    return F.filter(ref.col, lambda e: ~equals(Ref(e, element), v, False)), ref.col.isNull()


def updated(df: DataFrame, f: dict, ops: dict, position: list[str], one: bool = False, most: int | None = None) -> DataFrame:
    """The after image of every row, with _matched and _modified. One: only the first match in insertion order.

    Fails as a whole, when it runs and whatever columns are read, if a row doesn't allow the update (a null
    target of $inc, $push or $pull, a null parent, a sum out of range) or more rows than `most` match."""
    plan = compile_update(ops, position[0])
    hit = predicate(compile_filter(f), df.schema)
    if one:
        first = df.where(hit).agg(F.min(F.struct(*position)).alias("_first"))  # one row
        df1 = df.join(F.broadcast(first), F.lit(True), "left")
        hit = hit & F.coalesce(F.struct(*position) == F.col("_first"), F.lit(False))
    else:
        df1 = df
    by_column: dict[str, list] = {}
    for op, path, v in plan:
        by_column.setdefault(path.split(".")[0], []).append((op, path, v))
    if missing := [p for _, p, _ in plan if resolve(df.schema, p) is None]:
        raise MutationProblem(f"no column for {', '.join(missing)}: a typed collection has the fields of its schema")
    cols, changes, bad = [], [], []
    for name in df.columns:
        new = F.col(f"`{name}`")
        for op, path, v in by_column.get(name, []):
            ref = resolve(df.schema, path)
            got, wrong = _changed(op, ref, v)
            # a path through a null parent crosses a value that is no object; there is nothing there to unset
            bad += [c for c in (wrong, ~ref.found if ref.found is not None and op != "$unset" else None) if c is not None]
            new = got if path == name else new.withField(path.split(".", 1)[1], got)
        cols.append(F.when(F.col("_matched"), new).otherwise(F.col(f"`{name}`")).alias(name) if name in by_column else F.col(f"`{name}`"))
        if name in by_column:
            changes.append(~new.eqNullSafe(F.col(f"`{name}`")))
    changed = F.lit(False)
    for c in changes:
        changed = changed | c
    out = df1.withColumn("_matched", hit).select(*cols, "_matched", (F.col("_matched") & changed).alias("_modified"))
    if bad:
        wrong = bad[0]
        for c in bad[1:]:
            wrong = wrong | c
        out = _guarded(out, df1.where(hit & F.coalesce(wrong, F.lit(True))).limit(1), 0, "a row doesn't allow the update: a number out of range, or a value of another kind")
    return out if most is None else _guarded(out, df1.where(hit).limit(most + 1), most, f"the update matches over {most} rows")


def _guarded(df: DataFrame, rows: DataFrame, most: int, what: str) -> DataFrame:
    """df, or an error when it runs if rows are more than `most`. A branch of a union, so that it runs
    whatever columns are read and also where df is empty."""
    over = F.when(F.col("_n") > most, F.raise_error(F.lit(what)))
    n = rows.select(F.lit(1).alias("one")).agg(F.count("*").alias("_n")).where(over.isNotNull())
    return df.union(n.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]))


def update_many(df: DataFrame, f: dict, ops: dict, position: list[str]) -> DataFrame:
    return updated(df, f, ops, position).drop("_matched", "_modified")


def update_one(df: DataFrame, f: dict, ops: dict, position: list[str]) -> DataFrame:
    return updated(df, f, ops, position, one=True).drop("_matched", "_modified")


def changes(df: DataFrame, f: dict, ops: dict, position: list[str]) -> DataFrame:
    """Before and after images of the rows an update changes: the position's columns, before, after."""
    names = df.columns
    before = df.withColumn("_before", F.struct(*names))
    after = updated(before, f, ops, position).where("_modified")
    return after.select(*position, F.col("_before").alias("before"), F.struct(*names).alias("after"))


def delete_many(df: DataFrame, f: dict, most: int | None = None) -> DataFrame:
    hit = predicate(compile_filter(f), df.schema)
    rest = df.where(~hit)
    return rest if most is None else _guarded(rest, df.where(hit).limit(most + 1), most, f"the deletion matches over {most} rows")


def delete_one(df: DataFrame, f: dict, position: list[str]) -> DataFrame:
    first = df.where(predicate(compile_filter(f), df.schema)).agg(F.min(F.struct(*position)).alias("_first"))
    return df.join(F.broadcast(first), F.lit(True), "left").where(~F.coalesce(F.struct(*position) == F.col("_first"), F.lit(False))).drop("_first")


def insert_many(df: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """df and new together; a key that is there already, or twice in new, fails the query when it runs.

    Only the new rows are grouped; the old ones are met by a semi-join with the new keys, which Spark
    broadcasts where they are small."""
    twice = new.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").select(*key)
    there = df.select(*key).join(new.select(*key), key, "left_semi")
    return _guarded(df.unionByName(new), twice.unionByName(there).limit(1), 0, "a key is there already")


def upsert(df: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new in place of those with their key, and those that are new."""
    return df.join(new.select(*key), key, "left_anti").select(*df.columns).unionByName(new)


def unique_violations(df: DataFrame, fields: list[str]) -> DataFrame:
    """Keys of a unique index that more than one row has, and how many. Rows without the leading field aren't indexed."""
    return df.where(F.col(fields[0]).isNotNull()).groupBy(*fields).agg(F.count("*").alias("n")).where("n > 1")
