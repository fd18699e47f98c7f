"""A versioned store of schemaless collections: immutable Parquet segments and one manifest for each commit.

A commit adds segments: rows (the documents it wrote, whole) and dead (ids whose earlier rows no longer
count). Nothing is rewritten until compaction. A reader picks a manifest, so it sees one state whatever
is committed meanwhile. The manifest of token t is created once or not at all; that is the compare-and-set
of optimistic transactions. A transaction that loses is refused, never run again. Every commit's changes,
with images before and after, are a Parquet file that its manifest names: the change log."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkdoc.functions import jsondoc
from larkdoc.functions.mutate import UpdateProblem
from larkdoc.functions.values import RANK, ValueProblem, check_path
from larkdoc.operators import documents as D
from larkdoc.operators.collection import LimitReached
from larkdoc.operators.mutations import compile_update
from larkdoc.plans.filters import FilterProblem, Node, Query, compile_filter

from .files import Files

NAME = re.compile(r"[A-Za-z][A-Za-z0-9_-]{0,127}")
CHANGES = "seq long, collection string, op string, _id string, before string, after string, paths array<string>"
IMAGE = "_id string, _pos long, text string"
MAX_CHANGES = 10_000


class StoreProblem(RuntimeError):
    """An operation the store refuses."""


class WriteConflict(StoreProblem):
    """Another transaction committed what this one had read or written."""


class DuplicateKey(StoreProblem):
    """An id or a unique index's key is there already."""


class HistoryLost(StoreProblem):
    """The state asked for is no longer kept."""


@dataclass(frozen=True)
class Index:
    """One to four fields, each up or down, perhaps unique. A constraint and a hint; scans need no index."""

    name: str
    fields: tuple[tuple[str, int], ...]
    unique: bool = False

    def __post_init__(self) -> None:
        if not 1 <= len(self.fields) <= 4 or len({p for p, _ in self.fields}) != len(self.fields) or any(d not in (1, -1) for _, d in self.fields):
            raise StoreProblem("an index has one to four different fields, up or down")
        for p, _ in self.fields:
            check_path(p)


@dataclass(frozen=True)
class State:
    """One committed state, as its manifest says it."""

    token: int
    committed_at: int
    transaction: str
    collections: dict[str, dict] = field(default_factory=dict)
    changes: str | None = None
    events: tuple[dict, ...] = ()

    def text(self) -> str:
        return json.dumps({"token": self.token, "committed_at": self.committed_at, "transaction": self.transaction, "collections": self.collections, "changes": self.changes, "events": list(self.events)}, sort_keys=True)

    @staticmethod
    def of(text: str) -> State:
        w = json.loads(text)
        return State(**w | {"events": tuple(w["events"])})


class Store:
    """Opens the store at a folder, or makes an empty one there."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.files, self.stats = spark, Files(spark, root), Counter()
        if not self.tokens():
            self.files.create(_manifest(0), State(0, _now(), "").text())

    # states

    def tokens(self) -> list[int]:
        return [int(n.split(".")[0]) for n in self.files.names("manifest") if n.endswith(".json")]

    @property
    def token(self) -> int:
        return max(self.tokens())

    def state(self, token: int | None = None) -> State:
        token = self.token if token is None else token
        try:
            return State.of(self.files.read(_manifest(token)))
        except Exception as e:
            if self.files.exists(_manifest(token)):
                raise
            raise HistoryLost(f"no state of token {token}") from e

    def read(self, name: str, token: int | None = None) -> DataFrame:
        """(_id, _pos, doc) of a collection, now or at a token."""
        return _rows(self, self.state(token).collections.get(name, {}).get("segments", []))

    def collection(self, name: str, token: int | None = None) -> D.Documents:
        return D.Documents(self.read(name, token))

    def snapshot(self, name: str, q: Query, token: int | None = None) -> tuple[int, DataFrame]:
        """The token and the query's rows as they were then."""
        state = self.state(token)
        self.stats["queries"] += 1
        return state.token, D.Documents(_rows(self, state.collections.get(name, {}).get("segments", []))).run(q)

    def indexes(self, name: str) -> list[Index]:
        return [Index(i["name"], tuple(map(tuple, i["fields"])), i["unique"]) for i in self.state().collections.get(name, {}).get("indexes", [])]

    # commits

    def begin(self) -> Transaction:
        return Transaction(self, self.state())

    def run(self, work: Callable[[Transaction], Any]) -> Any:
        """work in one transaction: committed as one token, or nothing of it. A conflict is an error and work isn't run again."""
        tx = self.begin()
        out = work(tx)
        tx.commit()
        return out

    def create_collection(self, name: str) -> None:
        self.run(lambda t: t.create_collection(name))

    def create_index(self, name: str, index: Index) -> None:
        self.run(lambda t: t.create_index(name, index))

    def insert(self, name: str, docs: list[dict]) -> list[str]:
        return self.run(lambda t: t.insert(name, docs))

    def update(self, name: str, f: dict, ops: dict, one: bool = False, most: int | None = None) -> tuple[int, int]:
        return self.run(lambda t: t.update(name, compile_filter(f), compile_update(ops), one, most))

    def delete(self, name: str, f: dict, one: bool = False, most: int | None = None) -> int:
        return self.run(lambda t: t.delete(name, compile_filter(f), one, most))

    def upsert(self, name: str, docs: list[dict]) -> int:
        return self.run(lambda t: t.upsert(name, docs))

    def batch(self, name: str, put: list[dict] = (), remove: list[str] = ()) -> None:
        """Documents put and ids removed as one commit."""
        self.run(lambda t: (t.remove(name, list(remove)), t.upsert(name, list(put))))

    # the log

    def changes(self, after: int, until: int | None = None, collection: str | None = None) -> DataFrame:
        """(token, seq, collection, op, _id, before, after, paths) of the commits after a token."""
        if not self.can_resume_from(after):
            raise HistoryLost(f"no commits from token {after} on")
        parts = [(t, s.changes) for t in self.tokens() if after < t <= (until if until is not None else t) for s in [self.state(t)] if s.changes]
        out = self.spark.createDataFrame([], "token long, " + CHANGES)
        for t, at in parts:
            out = out.unionByName(self.spark.read.schema(CHANGES).parquet(self.files.path(at)).withColumn("token", F.lit(t).cast("long")))
        return out if collection is None else out.where(F.col("collection") == collection)

    def can_resume_from(self, token: int) -> bool:
        kept = self.tokens()
        return min(kept) - 1 <= token <= max(kept) and (token >= min(kept) or min(kept) == 0)

    # upkeep

    def compact(self, name: str) -> None:
        """One segment for the collection, as an empty commit: readers of other tokens keep theirs."""
        base = self.state()
        at = f"data/{name}/{uuid.uuid4().hex}"
        self.read(name, base.token).select("_id", "_pos", F.to_json("doc").alias("text")).write.parquet(self.files.path(at))
        collections = base.collections | {name: base.collections[name] | {"segments": [{"rows": at, "dead": None}]}}
        self._publish(replace(base, token=base.token + 1, committed_at=_now(), transaction=uuid.uuid4().hex, collections=collections, changes=None, events=()))

    def retain(self, commits: int, pinned: tuple[int, ...] = ()) -> None:
        """Drop states beyond the newest commits, but those pinned, and the files that only they use."""
        tokens = self.tokens()
        cut = min([tokens[-1] - commits + 1, *pinned])
        kept = [self.state(t) for t in tokens if t >= cut]
        for t in tokens:
            if t < cut:
                self.files.delete(_manifest(t))
        used = {s[k] for st in kept for c in st.collections.values() for s in c["segments"] for k in ("rows", "dead") if s[k]} | {st.changes for st in kept}
        for folder in ("data", "changes"):
            for name in self.files.names(folder):
                for at in [f"data/{name}/{x}" for x in self.files.names(f"data/{name}")] if folder == "data" else [f"changes/{name}"]:
                    if at not in used:
                        self.files.delete(at)

    def backup(self, target: str) -> Store:
        """The present state in a folder of its own, one segment a collection, the token kept."""
        state, out = self.state(), Files(self.spark, target)
        if out.names("manifest"):
            raise StoreProblem("the target holds a store already")
        collections = {}
        for name, c in state.collections.items():
            at = f"data/{name}/{uuid.uuid4().hex}"
            self.read(name, state.token).select("_id", "_pos", F.to_json("doc").alias("text")).write.parquet(out.path(at))
            collections[name] = c | {"segments": [{"rows": at, "dead": None}]}
        out.create(_manifest(state.token), replace(state, collections=collections, changes=None, events=()).text())
        return Store(self.spark, target)

    def _publish(self, state: State) -> None:
        if not self.files.create(_manifest(state.token), state.text()):
            raise WriteConflict(f"token {state.token} is taken")
        self.stats["commits"] += 1


def _manifest(token: int) -> str:
    return f"manifest/{token:020d}.json"


def _now() -> int:
    return int(time.time() * 1000)


def _rows(store: Store, segments: list[dict]) -> DataFrame:
    """What is left of the segments: rows whose id no later segment names as dead."""
    read = store.spark.read

    def union(key: str, schema: str) -> DataFrame | None:
        out = None
        for i, s in enumerate(segments):
            if s[key]:
                df = read.schema(schema).parquet(store.files.path(s[key])).withColumn("_s", F.lit(i))
                out = df if out is None else out.unionByName(df)
        return out

    rows, dead = union("rows", IMAGE), union("dead", "_id string")
    if rows is None:
        return store.spark.createDataFrame([], D.SCHEMA.replace("doc variant", "text string")).select("_id", "_pos", F.parse_json("text").alias("doc"))
    if dead is not None:
        last = dead.groupBy(F.col("_id").alias("_dead")).agg(F.max("_s").alias("_last"))
        rows = rows.join(last, (F.col("_id") == F.col("_dead")) & (F.col("_s") < F.col("_last")), "left_anti")
    return D.texts(rows)


class Transaction:
    """Reads of one state with its own writes on top, and one commit."""

    def __init__(self, store: Store, base: State) -> None:
        self.store, self.base = store, base
        self.collections = json.loads(json.dumps(base.collections))
        self.log: list[str] = []
        self.events: list[dict] = []
        self.fences: set[str] = set()  # collections read as a whole
        self.touched: dict[str, set[str]] = {}  # ids read or written
        self.size = 0

    def read(self, name: str) -> DataFrame:
        return _rows(self.store, self.collections.get(name, {}).get("segments", []))

    def find(self, name: str, q: Query) -> DataFrame:
        """A query over the whole collection: any commit to it from now on is a conflict."""
        self.fences.add(name)
        return D.Documents(self.read(name)).run(q)

    def get_one(self, name: str, id: str) -> dict:
        self.touched.setdefault(name, set()).add(id)
        got = D.as_documents(D.Documents(self.read(name)).by_id(id).limit(1))
        if not got:
            raise D.NotFound(id)
        return got[0]

    def create_collection(self, name: str) -> None:
        if not NAME.fullmatch(name):
            raise StoreProblem(f"not a collection's name: {name!r}")
        if name not in self.collections:
            self.collections[name] = {"segments": [], "next": 0, "indexes": []}
            self.events.append({"kind": "create_collection", "collection": name})

    def create_index(self, name: str, index: Index) -> None:
        self.create_collection(name)
        c = self.collections[name]
        if any(i["name"] == index.name for i in c["indexes"]):
            raise StoreProblem(f"an index {index.name} is there already")
        c["indexes"].append({"name": index.name, "fields": [list(f) for f in index.fields], "unique": index.unique})
        self.fences.add(name)
        self._check(name, None)
        self.events.append({"kind": "create_index", "collection": name, "index": index.name})

    def insert(self, name: str, docs: list[dict]) -> list[str]:
        """All or nothing; the collection is made if need be; documents without _id get one."""
        self.create_collection(name)
        first = self.collections[name]["next"]
        df = D.load(self.store.spark, docs, first)
        images = df.select("_id", "_pos", F.to_json("doc").alias("text"))
        ids = [r[0] for r in images.select("_id").collect()] if docs else []
        if len(set(ids)) != len(ids) or ids and D.Documents(self.read(name)).by_id(*ids).limit(1).count():
            raise DuplicateKey("an _id is there already")
        self.collections[name]["next"] = first + len(docs)
        if docs:
            self._write(name, "insert", images.select("*", F.lit(None).cast("string").alias("before")), (), len(docs))
        self.touched.setdefault(name, set()).update(ids)
        self.store.stats["inserted"] += len(docs)
        return ids

    def insert_frame(self, name: str, df: DataFrame) -> None:
        """Many documents (_id, _pos, doc) at once, their positions kept behind those that are there."""
        self.create_collection(name)
        first = self.collections[name]["next"]
        at = f"data/{name}/{uuid.uuid4().hex}"
        df.select("_id", (F.col("_pos") + first).alias("_pos"), F.to_json("doc").alias("text")).write.parquet(self.store.files.path(at))
        new = self.store.spark.read.schema(IMAGE).parquet(self.store.files.path(at))
        # the new ids against the old ones: the old collection isn't shuffled where the new rows are few
        if new.groupBy("_id").count().where("count > 1").limit(1).count() or self.read(name).join(new.select("_id"), "_id", "left_semi").limit(1).count():
            raise DuplicateKey("an _id is there already")
        n, last = new.agg(F.count("*"), F.max("_pos")).first()
        self.fences.add(name)
        self.collections[name]["segments"].append({"rows": at, "dead": None})
        self.collections[name]["next"] = (last if last is not None else first - 1) + 1
        self._record(name, "insert", new.select("_id", F.lit(None).cast("string").alias("before"), F.col("text").alias("after")), ())
        self._check(name, new.select("_id"))
        self.store.stats["inserted"] += n

    def update(self, name: str, where: Node, plan: list, one: bool = False, most: int | None = None) -> tuple[int, int]:
        """(matched, modified). An error in any document leaves all as they were; only changed ones are written."""
        return self._change(name, D.selected(self.read(name), where, one, most), plan)

    def update_one(self, name: str, id: str, ops: dict) -> tuple[int, int]:
        self.touched.setdefault(name, set()).add(id)
        return self._change(name, D.Documents(self.read(name)).by_id(id), compile_update(ops), fence=False)

    def _change(self, name: str, rows: DataFrame, plan: list, fence: bool = True) -> tuple[int, int]:
        at = f"aside/{uuid.uuid4().hex}"
        D.images(rows, plan).write.parquet(self.store.files.path(at))
        got = self.store.spark.read.parquet(self.store.files.path(at))
        matched, modified, error = got.agg(F.count("*"), F.count_if("modified"), F.min("error")).first()
        if error is not None:
            raise UpdateProblem(error)
        self.fences |= {name} if fence else set()
        if modified:
            self._write(name, "update", got.where("modified").select("_id", "_pos", F.col("after").alias("text"), "before"), tuple(sorted(p for _, p, _ in plan)), modified)
        self.store.stats["modified"] += modified
        self.store.files.delete(at)
        return matched, modified

    def replace_one(self, name: str, id: str, doc: dict) -> None:
        old = self.get_one(name, id)
        if doc.get("_id", old["_id"]) != old["_id"]:
            raise StoreProblem("the id doesn't change")
        rows = D.Documents(self.read(name)).by_id(id).select("_id", "_pos", F.lit(jsondoc.to_text({**doc, "_id": old["_id"]})).alias("text"), F.to_json("doc").alias("before"))
        self._write(name, "update", rows, None, 1)

    def delete(self, name: str, where: Node, one: bool = False, most: int | None = None) -> int:
        self.fences.add(name)
        return self._remove(name, D.selected(self.read(name), where, one, most))

    def remove(self, name: str, ids: list[str]) -> int:
        self.touched.setdefault(name, set()).update(ids)
        return self._remove(name, D.Documents(self.read(name)).by_id(*ids)) if ids and name in self.collections else 0

    def _remove(self, name: str, rows: DataFrame) -> int:
        n = rows.select("_id").count()
        if n:
            self._write(name, "delete", rows.select("_id", "_pos", F.lit(None).cast("string").alias("text"), F.to_json("doc").alias("before")), (), n)
        self.store.stats["deleted"] += n
        return n

    def upsert(self, name: str, docs: list[dict]) -> int:
        """Replace by id where it is there, insert where not; returns how many were there."""
        self.create_collection(name)
        docs = [D.with_id(d) for d in docs]
        ids = [d["_id"].hex if hasattr(d["_id"], "hex") else d["_id"] for d in docs]
        there = {r[0] for r in D.Documents(self.read(name)).by_id(*ids).select("_id").collect()} if ids else set()
        for d, i in zip(docs, ids, strict=True):
            if i in there:
                self.replace_one(name, i, d)
        self.insert(name, [d for d, i in zip(docs, ids, strict=True) if i not in there])
        return len(there)

    def _write(self, name: str, op: str, rows: DataFrame, paths: tuple | None, n: int) -> None:
        """A segment and its log: rows(_id, _pos, text, before), text null for a deletion."""
        self.size += n
        if self.size > MAX_CHANGES and op != "insert":
            raise LimitReached(f"a transaction changes {MAX_CHANGES} documents at most")
        at = f"data/{name}/{uuid.uuid4().hex}"
        rows.write.parquet(self.store.files.path(at))
        rows = self.store.spark.read.schema(IMAGE + ", before string").parquet(self.store.files.path(at))
        self.collections[name]["segments"].append({"rows": at if op != "delete" else None, "dead": at if op != "insert" else None})
        self._record(name, op, rows.select("_id", "before", F.col("text").alias("after")), paths)
        if op != "delete":
            self._check(name, rows.select("_id"))

    def _record(self, name: str, op: str, rows: DataFrame, paths: tuple | None) -> None:
        at = f"aside/{uuid.uuid4().hex}"
        known = F.lit(None).cast("array<string>") if paths is None else F.array(*map(F.lit, paths)).cast("array<string>")
        rows.select(F.lit(len(self.log)).cast("long").alias("seq"), F.lit(name).alias("collection"), F.lit(op).alias("op"), "_id", "before", "after", known.alias("paths")).write.parquet(self.store.files.path(at))
        self.log.append(at)

    def _check(self, name: str, new: DataFrame | None) -> None:
        """Indexes over the state as it would be: indexed fields hold scalars, unique keys come once. Only keys of new rows are looked at."""
        for i in self.collections[name]["indexes"]:
            values = [D.at(F.col("doc"), p) for p, _ in i["fields"]]
            rows = self.read(name).where(values[0].isNotNull())  # without the leading field a document isn't indexed
            keys = [D.key_column(v) for v in values]
            rows = rows.select("_id", *[k.alias(f"k{n}") for n, k in enumerate(keys)])
            mine = rows if new is None else rows.join(new, "_id", "left_semi")
            names = [f"k{n}" for n in range(len(keys))]
            if mine.where(F.greatest(*[F.coalesce(F.col(f"{k}.k"), F.lit(0)) for k in names], F.lit(0)) >= RANK["array"]).limit(1).count():
                raise StoreProblem(f"index {i['name']} takes scalars only")
            if i["unique"]:
                whole = " and ".join(f"{k} is not null" for k in names)  # a key with a missing field conflicts with none
                some = rows.where(whole).join(mine.where(whole).select(*names).distinct(), names, "left_semi")
                if some.groupBy(*names).count().where("count > 1").limit(1).count():
                    raise DuplicateKey(f"index {i['name']} has that key already")

    def commit(self) -> int:
        """The token of the new state; without writes the base's, and nothing is committed."""
        if not self.log and not self.events:
            return self.base.token
        for _ in range(1000):
            latest = self.store.state()
            if latest.token != self.base.token:
                self._rebase(latest)
            changes = None
            if self.log:
                changes = f"changes/{uuid.uuid4().hex}"
                self.store.spark.read.schema(CHANGES).parquet(*[self.store.files.path(a) for a in self.log]).write.parquet(self.store.files.path(changes))
            state = State(self.base.token + 1, _now(), uuid.uuid4().hex, self.collections, changes, tuple(self.events))
            try:
                self.store._publish(state)
            except WriteConflict:
                continue  # someone was faster: look at what they changed
            for a in self.log:
                self.store.files.delete(a)
            return state.token
        raise WriteConflict("no token to be had")

    def _rebase(self, latest: State) -> None:
        """On top of other commits, where they touched nothing of ours; else a conflict."""
        if min(self.store.tokens()) > self.base.token:
            raise WriteConflict("the base is no longer kept")
        others = self.store.changes(self.base.token, latest.token)
        mine = self.store.spark.createDataFrame([(c, i) for c, ids in self.touched.items() for i in ids], "collection string, _id string")
        if any(not latest.collections.get(n, {}).get("segments", []) == self.base.collections.get(n, {}).get("segments", []) for n in self.fences) or others.join(mine, ["collection", "_id"], "left_semi").limit(1).count():
            raise WriteConflict("another commit touched what this transaction read or wrote")
        merged = json.loads(json.dumps(latest.collections))
        for n, c in self.collections.items():
            old = self.base.collections.get(n, {"segments": [], "next": 0, "indexes": []})
            if c == old:
                continue
            there = merged.get(n, {"segments": [], "next": 0, "indexes": []})
            if there["next"] != old["next"] and c["next"] != old["next"] or there["indexes"] != old["indexes"] or any(i["unique"] for i in there["indexes"]) and there != old:
                raise WriteConflict(f"both transactions extend {n}")
            merged[n] = {"segments": there["segments"] + c["segments"][len(old["segments"]) :], "next": max(c["next"], there["next"]), "indexes": c["indexes"]}
        self.collections, self.base = merged, replace(latest)
