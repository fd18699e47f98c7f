"""A collection: a DataFrame with a declared insertion order, and the reads on it. All lazy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkdoc.plans.filters import FilterProblem, Query, continuation, query

from .lowering import ordering, predicate, projection, resolve

MAX_GROUPS = 100


class LimitReached(RuntimeError):
    """More groups or rows than an operation allows."""


MAX_SKIP = 100_000


def without_first(df: DataFrame, order: list, skip: int, position: list[str]) -> DataFrame:
    """All rows but the first ones: those are a bounded top-k, and the rest needn't be sorted to drop them."""
    if skip > MAX_SKIP:
        raise LimitReached(f"skip is {MAX_SKIP} at most")
    first = df.orderBy(*order).limit(skip).select(*[F.col(f"`{p}`").alias(f"_skip{i}") for i, p in enumerate(position)])
    same = [F.col(f"`{p}`").eqNullSafe(F.col(f"_skip{i}")) for i, p in enumerate(position)]
    return df.join(F.broadcast(first), same, "left_anti")


@dataclass(frozen=True)
class Collection:
    df: DataFrame
    position: tuple[str, ...]  # columns whose order is the insertion order; unique together

    def where(self, q: Query) -> DataFrame:
        return self.df.where(predicate(q.where, self.df.schema))

    def run(self, q: Query, project: list[str] | None = None) -> DataFrame:
        """Filter, order, window and projection. Sorting only happens where a window or the caller's sort needs it."""
        got, order = self.where(q), ordering(self.df.schema, q.sort, list(self.position))
        if q.skip and q.limit is None:
            got = without_first(got, order, q.skip, list(self.position))
            got = got.orderBy(*order) if q.sort else got
        elif q.sort or q.limit is not None:
            got = got.orderBy(*order)
            got = got.offset(q.skip) if q.skip else got
            got = got.limit(q.limit) if q.limit is not None else got
        return got.select(*projection(self.df.schema, project)) if project else got

    def find(self, f: dict | None = None, sort=(), skip: int = 0, limit: int | None = None, project: list[str] | None = None) -> DataFrame:
        return self.run(query(f, sort, skip, limit), project)

    def find_one(self, f: dict | None = None) -> DataFrame:
        return self.find(f, limit=1)

    def count(self, f: dict | None = None, most: int | None = None) -> DataFrame:
        """One row: count, and with `most` whether that bound was reached (an exact hit counts as reached)."""
        got = self.where(query(f)).select(F.lit(1).alias("one"))
        if most is None:
            return got.agg(F.count("*").alias("count"))
        return got.limit(most).agg(F.count("*").alias("count")).withColumn("capped", F.col("count") == most)

    def group_count(self, field: str, f: dict | None = None, most: int | None = None, max_groups: int | None = MAX_GROUPS) -> DataFrame:
        """Counts by a top-level field; a missing field counts as null. Over max_groups groups the query fails when it runs."""
        if "." in field:
            raise FilterProblem("a grouped field has no dots")
        got = self.where(query(f))
        if most is not None:  # the first rows in insertion order
            got = got.orderBy(*[F.col(p) for p in self.position]).limit(most)
        key = F.col(f"`{field}`") if resolve(self.df.schema, field) else F.lit(None).cast("string")
        got = got.groupBy(key.alias("key")).agg(F.count("*").alias("count"))
        if max_groups is None:
            return got
        # one row more than allowed is enough to know, and no more than that is gathered
        some = got.limit(max_groups + 1).agg(F.count("*").alias("n")).select(F.when(F.col("n") > max_groups, F.raise_error(F.lit(f"over {max_groups} groups"))).alias("over"))
        return got.join(F.broadcast(some), F.lit(True), "left").where(F.col("over").isNull()).drop("over")

    def page(self, sort: list[tuple[str, int]], first: int, after: dict | None = None, f: dict | None = None, key: str | None = None) -> DataFrame:
        """Keyset pagination: the first rows behind `after`, a row's sort values. The key is appended to the sort."""
        sort = [*sort, (key or self.position[0], 1)] if (key or self.position[0]) not in [p for p, _ in sort] else list(sort)
        q = query(f, sort, 0, first)
        return self.run(q if after is None else q.constrain(continuation(sort, after)))
