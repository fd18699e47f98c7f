"""Logical archives: a store's present state as JSON lines that end in their own SHA-256.

Lines are header, collections, documents in insertion order, indexes and an end record with counts and the
digest of all bytes before it. The digest goes by line order, so lines pass the driver one after the
other; nothing is held but a buffer."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkdoc.functions import jsondoc
from larkdoc.functions.values import ValueProblem, from_wire, strict_json, to_wire

from .files import Files
from .store import Index, Store, StoreProblem

FORMAT, VERSION = "larkdoc-archive", 1


class ArchiveProblem(StoreProblem):
    """An archive that is cut off, changed or of another format."""


def _line(record: dict) -> str:
    return json.dumps(record, separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(T.StringType())
def _document_line(collection: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([_line({"kind": "document", "collection": c, "document": to_wire(jsondoc.from_text(t))}) for c, t in zip(collection, text, strict=True)])


@F.pandas_udf(T.StructType([T.StructField("_id", T.StringType()), T.StructField("text", T.StringType())]))
def _parsed(line: pd.Series) -> pd.DataFrame:
    out = []
    for x in line:
        d = from_wire(strict_json(x)["document"])
        out.append((d["_id"].hex if hasattr(d["_id"], "hex") else d["_id"], jsondoc.to_text(d)))
    return pd.DataFrame(out, columns=["_id", "text"])


def document_lines(df: DataFrame, collection: str) -> DataFrame:
    """(_pos, line) of a collection's documents."""
    return df.select("_pos", _document_line(F.lit(collection), F.to_json("doc")).alias("line"))


def export(store: Store, path: str) -> dict:
    """Writes one file; returns the end record."""
    state, digest = store.state(), hashlib.sha256()
    counts = {"collections": 0, "documents": 0, "indexes": 0}
    end: dict = {}

    def lines() -> Iterator[str]:
        yield _line({"kind": "header", "format": FORMAT, "version": VERSION})
        for name in sorted(state.collections):
            counts["collections"] += 1
            yield _line({"kind": "collection", "name": name})
            for r in document_lines(store.read(name, state.token), name).orderBy("_pos").toLocalIterator(prefetchPartitions=True):
                counts["documents"] += 1
                yield r["line"]
            for i in state.collections[name]["indexes"]:
                counts["indexes"] += 1
                yield _line({"kind": "index", "collection": name, "name": i["name"], "fields": [{"field": p, "order": d} for p, d in i["fields"]], "unique": i["unique"]})

    def hashed() -> Iterator[str]:
        for x in lines():
            digest.update(x.encode() + b"\n")
            yield x
        end.update({"kind": "end", **counts, "sha256": digest.hexdigest()})
        yield _line(end)

    folder, _, name = path.rpartition("/")
    Files(store.spark, folder).lines_to(name, hashed())
    return end


def load(store: Store, path: str, most: int = 1 << 40) -> dict:
    """Reads an archive into an empty store: checked whole first, then one commit."""
    if store.token or store.state().collections:
        raise ArchiveProblem("the store isn't empty")
    text = store.spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))
    digest, size, counts, names, indexes, held, last = hashlib.sha256(), 0, {"collections": 0, "documents": 0, "indexes": 0}, [], [], "", None
    for r in text.orderBy("n").toLocalIterator(prefetchPartitions=True):
        if last is not None:
            raise ArchiveProblem("something comes behind the end")
        if held:
            digest.update(held.encode() + b"\n")
        held = r["line"]
        size += len(held)
        if size > most:
            raise ArchiveProblem("the archive exceeds its limit")
        if held.startswith('{"kind":"document",'):
            counts["documents"] += 1
            continue
        try:
            record = strict_json(held)
            kind = record["kind"]
        except (ValueError, KeyError, TypeError) as e:
            raise ArchiveProblem("a line is no record") from e
        if (kind == "header") != (size == len(held)):
            raise ArchiveProblem("the header comes first, and once")
        if kind == "header" and (record["format"], record["version"]) != (FORMAT, VERSION):
            raise ArchiveProblem("another format")
        if kind == "collection":
            counts["collections"] += 1
            names.append(record["name"])
        elif kind == "index":
            counts["indexes"] += 1
            indexes.append(record)
        elif kind == "end":
            last = record
        elif kind != "header":
            raise ArchiveProblem(f"no record {kind}")
    if last is None or last != {"kind": "end", **counts, "sha256": digest.hexdigest()}:
        raise ArchiveProblem("the archive is cut off or changed")
    tx = store.begin()
    at = F.get_json_object("line", "$.collection")
    docs = text.where(F.col("line").startswith('{"kind":"document",'))
    try:
        for name in names:
            tx.create_collection(name)
            mine = docs.where(at == name).withColumn("x", _parsed("line"))
            tx.insert_frame(name, mine.select("x._id", F.col("n").alias("_pos"), F.parse_json("x.text").alias("doc")))
        for i in indexes:
            tx.create_index(i["collection"], Index(i["name"], tuple((f["field"], f["order"]) for f in i["fields"]), i["unique"]))
    except ValueProblem as e:
        raise ArchiveProblem(str(e)) from e
    tx.commit()
    return last
