"""Change feeds and live views over a store, on Structured Streaming.

The stream's source is the folder of manifests: a file appears there when, and only when, a commit is
made. A micro-batch brings some tokens; they are taken in token order, each exactly the one after the
last, and those seen already are passed over, so a batch that runs again changes nothing. Progress is the
stream's own checkpoint, acknowledged when a batch returns.

A view keeps the snapshot of one query. A commit whose images match the query neither before nor after
leaves it alone; else the window is read again from the state of that token, where filter and top-k run
distributed. Views are bounded: a result of more rows than MAX_VIEW is refused."""

from __future__ import annotations

import hashlib
import hmac
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkdoc.functions import jsondoc
from larkdoc.functions.evaluate import lookup
from larkdoc.operators import documents as D
from larkdoc.operators.collection import LimitReached
from larkdoc.plans.filters import Query
from larkdoc.plans.wire import encode_query
from larkdoc.sources.store import CHANGES, HistoryLost, State, Store

from . import deltas

MAX_VIEW = 10_000


class Gap(RuntimeError):
    """A token is missing: the reader starts again from a snapshot."""


def feed(store: Store, handle: Callable[[State, DataFrame], None], checkpoint: str, collection: str | None = None, after: int = 0, empty: bool = True) -> StreamingQuery:
    """handle(state, changes) for every commit after a token, in order; at least once, until the batch ends.

    With a collection only its changes come; empty says whether commits without any are delivered, so
    that a reader's position goes on. Runs through what is there and stops (availableNow)."""
    source = store.spark.readStream.schema("value string").option("wholetext", "true").text(store.files.path("manifest"))
    seen = {"token": after}

    def batch(df: DataFrame, _: int) -> None:
        for s in sorted((State.of(r["value"]) for r in df.collect()), key=lambda s: s.token):  # manifests, one small row a commit
            if s.token <= seen["token"]:
                continue
            if s.token != seen["token"] + 1:
                raise Gap(f"token {s.token} comes after {seen['token']}")
            changes = store.spark.read.schema(CHANGES).parquet(store.files.path(s.changes)) if s.changes else store.spark.createDataFrame([], CHANGES)
            changes = changes.where(F.col("collection") == collection) if collection else changes
            if empty or s.changes and changes.limit(1).count():
                handle(s, changes)
            seen["token"] = s.token

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@dataclass
class View:
    """The live result of one query: its snapshot, and subscribers that get snapshots or deltas."""

    store: Store
    collection: str
    q: Query
    snapshot: deltas.Snapshot = (0, [])
    subscribers: list[Callable[[deltas.Snapshot, deltas.Delta | None], None]] = field(default_factory=list)
    dropped: list[Exception] = field(default_factory=list)

    @property
    def name(self) -> str:
        """Equal queries over a collection are one view."""
        return f"{self.collection} {encode_query(self.q)}"

    def open(self, token: int | None = None) -> deltas.Snapshot:
        """The result now, or at a token that is still kept."""
        token = self.store.state(token).token
        self.snapshot = (token, self._result(token))
        return self.snapshot

    def _result(self, token: int) -> list[tuple[str, dict]]:
        _, rows = self.store.snapshot(self.collection, self.q, token)
        if self.q.limit is None or self.q.limit > MAX_VIEW:
            rows = rows if self.q.sort else rows.orderBy("_pos")
            rows = rows.limit(MAX_VIEW + 1)
        got = [(r["_id"], jsondoc.from_text(r["text"])) for r in rows.select("_id", F.to_json("doc").alias("text")).collect()]
        if len(got) > MAX_VIEW:
            raise LimitReached(f"a view holds {MAX_VIEW} documents at most")
        return got

    def concerned(self, changes: DataFrame) -> bool:
        """Whether an image of a change, before or after, matches the query."""
        mine = changes.where(F.col("collection") == self.collection)
        images = mine.select(F.explode(F.array("before", "after")).alias("text")).where("text is not null").select(F.parse_json("text").alias("doc"))
        return images.where(D.predicate(self.q.where, F.col("doc"))).limit(1).count() > 0

    def advance(self, state: State, changes: DataFrame) -> deltas.Delta | None:
        """One commit: the delta it makes, or None where the visible result stays the same."""
        if state.token <= self.snapshot[0]:
            return None
        old = self.snapshot
        new = (state.token, self._result(state.token) if self.concerned(changes) else old[1])
        delta = deltas.build(old, new)
        # an unchanged result isn't told: the next delta goes on from the last one that was
        if not delta.operations:
            return None
        self.snapshot = new
        for s in list(self.subscribers):
            try:
                s(new, delta)
            except Exception as e:  # one that fails is dropped; the others go on
                self.subscribers.remove(s)
                self.dropped.append(e)
        return delta


class Views:
    """Views by name: one for each query over a collection, however many subscribe."""

    def __init__(self, store: Store) -> None:
        self.store, self.views = store, {}

    def subscribe(self, collection: str, q: Query, to: Callable[[deltas.Snapshot, deltas.Delta | None], None]) -> View:
        view = View(self.store, collection, q)
        if view.name not in self.views:
            view.open()
            self.views[view.name] = view
        view = self.views[view.name]
        to(view.snapshot, None)
        view.subscribers.append(to)
        return view

    def handle(self, state: State, changes: DataFrame) -> None:
        for v in self.views.values():
            v.advance(state, changes)


def replay(store: Store, collection: str, q: Query, token: int) -> list[deltas.Delta]:
    """The deltas of a view since a token whose state is still kept; HistoryLost where it isn't."""
    if not store.can_resume_from(token):
        raise HistoryLost(f"token {token}")
    view, out = View(store, collection, q), []
    view.open(token)
    for t in store.tokens():
        if t > token:
            s = store.state(t)
            d = view.advance(s, store.spark.read.schema(CHANGES).parquet(store.files.path(s.changes)) if s.changes else store.spark.createDataFrame([], CHANGES))
            out += [d] if d else []
    return out


def project(doc: dict, keep: list[str]) -> dict:
    """_id and some dotted paths; absent ones, and objects left empty, go."""
    out = {"_id": doc["_id"]} if "_id" in doc else {}
    for path in keep:
        found, v = lookup(doc, path)
        if found:
            *head, name = path.split(".")
            at = out
            for p in head:
                at = at.setdefault(p, {})
            at[name] = v
    return out


@dataclass
class Overlay:
    """What one connection sees of a view: projected snapshots, deltas between those, and nothing where no visible field changed."""

    keep: list[str]
    seen: deltas.Snapshot | None = None

    def take(self, snapshot: deltas.Snapshot) -> deltas.Snapshot | deltas.Delta | None:
        now = (snapshot[0], [(i, project(d, self.keep)) for i, d in snapshot[1]])
        if self.seen is None:
            self.seen = now
            return now
        delta = deltas.build(self.seen, now)
        if not delta.operations:
            return None  # the visible token stays, so that the next delta joins on
        self.seen = now
        return delta


@dataclass(frozen=True)
class ResumeTokens:
    """Signed positions: valid for one store, actor, collection, query and policy until they expire."""

    key: bytes
    seconds: int = 3600

    def _sign(self, body: bytes) -> str:
        return hmac.new(self.key, body, hashlib.sha256).hexdigest()

    def issue(self, claims: dict[str, Any], position: int, now: float | None = None) -> str:
        body = json.dumps(claims | {"position": position, "expires": (time.time() if now is None else now) + self.seconds}, sort_keys=True).encode()
        return body.hex() + "." + self._sign(body)

    def position(self, token: str, claims: dict[str, Any], now: float | None = None) -> int | None:
        """The position, or None for a token that is false, expired or of something else: then start from a snapshot."""
        head, _, sign = token.partition(".")
        try:
            body = bytes.fromhex(head)
            w = json.loads(body) if hmac.compare_digest(self._sign(body), sign) else {}
        except ValueError:
            return None
        good = w and w["expires"] > (time.time() if now is None else now) and all(w.get(k) == v for k, v in claims.items())
        return w["position"] if good else None


class Follower:
    """A replica: applies another store's commits in token order, each once; read-only until promoted."""

    def __init__(self, source: Store, target: Store) -> None:
        self.source, self.target, self.promoted = source, target, False

    def catch_up(self) -> int:
        """Takes the commits that are missing, one by one; returns the token reached."""
        if self.promoted:
            raise PermissionError("a promoted replica follows no one")
        if not self.source.can_resume_from(self.target.token):
            raise HistoryLost("the source no longer keeps what the replica needs")
        for t in self.source.tokens():
            if t > self.target.token:
                if t != self.target.token + 1:
                    raise Gap(f"token {t} comes after {self.target.token}")
                s = self.source.state(t)
                for c in s.collections.values():
                    for seg in c["segments"]:
                        for at in {seg["rows"], seg["dead"]} - {None}:
                            self._copy(at)
                if s.changes:
                    self._copy(s.changes)
                self.target._publish(replace(s))
        return self.target.token

    def _copy(self, at: str) -> None:
        if not self.target.files.exists(f"{at}/_SUCCESS"):
            self.source.spark.read.parquet(self.source.files.path(at)).write.mode("overwrite").parquet(self.target.files.path(at))

    def promote(self) -> Store:
        """The replica as a store of its own; from now on it takes no more commits of the source."""
        self.promoted = True
        return self.target
