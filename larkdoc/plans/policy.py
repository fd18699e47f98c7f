"""Row and field rules that rewrite queries and mutations before they run."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame

from .filters import MAX_LIMIT, FilterProblem, Node, Query, compile_filter, operators, paths

MODES = ("collaborative", "owner", "read_only", "rpc_only")


class Denied(PermissionError):
    """A rule forbids the query."""


def _meet(a, b):
    return b if a is None else a if b is None else a & b


def _under(path: str, prefixes) -> bool:
    return any(path == p or path.startswith(p + ".") for p in prefixes)


@dataclass(frozen=True)
class Policy:
    """None grants everything. Filter and sort paths are granted exactly, _id always; "*" among the
    operators grants all of them; a result path grants what lies below it."""

    rows: Node = ("true",)
    filter_paths: frozenset[str] | None = None
    operators: frozenset[str] | None = None
    sort_paths: frozenset[str] | None = None
    result_paths: tuple[str, ...] | None = None
    aggregate_fields: frozenset[str] | None = None
    max_results: int | None = None
    version: str = ""

    def check(self, q: Query) -> None:
        for allowed, used, what in ((self.filter_paths, paths(q.where), "filter"), (self.sort_paths, {p for p, _ in q.sort}, "sort")):
            if allowed is not None and (bad := used - allowed - {"_id"}):
                raise Denied(f"{what} on {', '.join(sorted(bad))}")
        if self.operators is not None and "*" not in self.operators and (bad := operators(q.where) - self.operators - {"true"}):
            raise Denied(f"operators {', '.join(sorted(bad))}")
        if q.seek and any(not self.shows(p) for p, _ in q.sort):  # a cursor would tell what the row doesn't show
            raise Denied("seek on a field that isn't shown")

    def apply(self, q: Query) -> Query:
        """The query with the rule in front of its own filter and its limit lowered, or Denied."""
        self.check(q)
        q = q if self.rows == ("true",) else q.constrain(self.rows)
        return q if self.max_results is None else q.capped(self.max_results)

    def shows(self, path: str) -> bool:
        return self.result_paths is None or path == "_id" or _under(path, self.result_paths)

    def find(self, collection, q: Query, key: tuple[str, ...] = ()) -> DataFrame:
        project = None if self.result_paths is None else [*key, *(p for p in self.result_paths if p not in key)]
        return collection.run(self.apply(q), project)

    def group_count(self, collection, name: str, q: Query) -> DataFrame:
        """Grouping tells the field's values: it needs the grant to aggregate and to see the field."""
        if self.aggregate_fields is not None and name not in self.aggregate_fields or not self.shows(name):
            raise Denied(f"grouping by {name}")
        self.check(q)
        got = replace(collection, df=collection.run(replace(q, where=("and", [self.rows, q.where]))))
        return got.group_count(name, most=self.max_results)

    def __and__(self, other: Policy) -> Policy:
        result = self.result_paths if other.result_paths is None else other.result_paths
        if None not in (self.result_paths, other.result_paths):  # what both show: the longer of two paths of which one lies below the other
            result = tuple(dict.fromkeys([p for p in self.result_paths if _under(p, other.result_paths)] + [p for p in other.result_paths if _under(p, self.result_paths)]))
        most = min((m for m in (self.max_results, other.max_results) if m is not None), default=None)
        ops = _meet(*(None if p.operators is not None and "*" in p.operators else p.operators for p in (self, other)))
        return Policy(
            ("and", [self.rows, other.rows]), _meet(self.filter_paths, other.filter_paths), ops, _meet(self.sort_paths, other.sort_paths), result,
            _meet(self.aggregate_fields, other.aggregate_fields), most, f"{self.version}&{other.version}" if other.version else self.version,
        )


@dataclass(frozen=True)
class MutationPolicy:
    """What an update or deletion may select and touch."""

    query: Policy = Policy()
    allowed_paths: frozenset[str] | None = None
    denied_paths: tuple[str, ...] = ()  # with all below them
    max_affected: int = 1000

    def apply(self, q: Query, plan: list[tuple[str, str, Any]] = ()) -> tuple[Node, int]:
        """The filter to mutate by and the most documents it may match; over that nothing is changed."""
        if q.sort or q.skip or q.limit is not None:
            raise FilterProblem("a mutation's query has no sort, skip or limit")
        for _, p, _ in plan:
            if _under(p, self.denied_paths) or self.allowed_paths is not None and p not in self.allowed_paths:
                raise Denied(f"a change of {p}")
        if not 0 < self.max_affected <= MAX_LIMIT:
            raise Denied("no mutations")
        self.query.check(q)
        return (q if self.query.rows == ("true",) else q.constrain(self.query.rows)).where, self.max_affected


@dataclass(frozen=True)
class InsertPolicy:
    """Fields a caller may give, and those set for them whatever they gave."""

    set_fields: dict[str, Any] = field(default_factory=dict)
    allowed_fields: frozenset[str] | None = None
    result_paths: tuple[str, ...] | None = None

    def apply(self, doc: dict) -> dict:
        if self.allowed_fields is not None and (bad := set(doc) - self.allowed_fields - {"_id"}):
            raise Denied(f"fields {', '.join(sorted(bad))}")
        if bad := set(doc) & set(self.set_fields):
            raise Denied(f"{', '.join(sorted(bad))} is set by the server")
        return doc | self.set_fields


@dataclass(frozen=True)
class Access:
    """How one collection may be used: together, by owner, for reading, or through procedures only."""

    mode: str
    workspace_field: str
    owner_field: str | None = None
    query_paths: frozenset[str] | None = None
    aggregate_fields: frozenset[str] | None = None
    result_fields: tuple[str, ...] | None = None
    input_fields: frozenset[str] | None = None
    update_paths: frozenset[str] | None = None
    max_results: int = 1000
    max_affected: int = 100

    def __post_init__(self) -> None:
        if self.mode not in MODES or (self.mode == "owner") != (self.owner_field is not None):
            raise ValueError(f"modes are {', '.join(MODES)}; an owner field belongs to mode owner")

    def _fixed(self, workspace: str, user: str) -> dict[str, Any]:
        return {self.workspace_field: workspace} | ({self.owner_field: user} if self.mode == "owner" else {})

    def reading(self, workspace: str, user: str) -> Policy:
        if self.mode == "rpc_only":
            raise Denied("procedures only")
        paths_ = self.query_paths
        return Policy(compile_filter(self._fixed(workspace, user)), paths_, frozenset({"*"}), paths_, self.result_fields, self.aggregate_fields, self.max_results, f"{self.mode}:{workspace}:{user}")

    def inserting(self, workspace: str, user: str) -> InsertPolicy:
        self._writes()
        return InsertPolicy(self._fixed(workspace, user), self.input_fields, self.result_fields)

    def mutating(self, workspace: str, user: str) -> MutationPolicy:
        self._writes()
        return MutationPolicy(self.reading(workspace, user), self.update_paths, tuple(self._fixed(workspace, user)), self.max_affected)

    def _writes(self) -> None:
        if self.mode in ("read_only", "rpc_only"):
            raise Denied(f"the collection is {self.mode}")


@dataclass
class Lease:
    """A policy that has to be asked for again when it runs out; one that changed or went ends what was opened under it."""

    resolve: Callable[[], Policy]
    seconds: float
    policy: Policy | None = None
    until: float = 0.0

    def current(self, now: float | None = None) -> tuple[Policy, bool]:
        """The policy, and whether it changed: then readers start from a new snapshot."""
        now = time.monotonic() if now is None else now
        changed = False
        if self.policy is None or now >= self.until:
            new = self.resolve()
            changed, self.policy, self.until = self.policy is not None and new != self.policy, new, now + self.seconds
        return self.policy, changed

    def revoke(self) -> None:
        self.until = 0.0


def workspace(field_: str, value, owner: tuple[str, object] | None = None, **rest) -> Policy:
    """Only rows of one workspace, and of one owner if given."""
    return Policy(compile_filter({field_: value} | ({owner[0]: owner[1]} if owner else {})), **rest)
