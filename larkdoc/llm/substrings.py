"""Substring dedup by relative Lempel-Ziv parsing.

A window is 13 consecutive words. Every window has an anchor, the smallest hash of its 4-word
runs, so windows with equal words have equal anchors wherever they stand. Runs of windows with
one anchor form a segment; a reference block holds the segments of one anchor, and equal windows
never lie in different blocks. Anchors of a single document are left out before any text moves.
In a block, segments come by document id, the words of earlier ones are indexed, and each segment
is factored greedily against them: the longest match that starts at an indexed window becomes a
factor; at its end the windows across the factor boundary are looked up one by one before parsing
goes on behind them. Factors of 13 words or more from smaller ids are duplicate spans. A block with
very many segments (a passage in a third of all documents) is split: segments with equal words are
one, whose repetitions in larger documents are factors as a whole, and the different ones are cut into
blocks of one window each, in which only the smallest id matters; both combine map-side.

Defined results: null and empty texts have no words and lose none; texts under 13 words lose none;
rows with one doc_id are one document and take nothing from each other; rows without doc_id lose
nothing and aren't references; repeated rows get equal results; extra columns pass through, whatever their
names (one called _kept is replaced); an empty table gives an empty one."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, fresh, release, small_batches, staged, table

WINDOW = 13
RUN = 4
HOT = 2000  # segments of one anchor from which its block is split
_MULT = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = bytes(32 if 9 <= c <= 13 else c for c in range(256))
_WORD = np.array([c != 32 and not 9 <= c <= 13 for c in range(256)])


def words(text: str | None) -> list[str]:
    if not text:
        return []
    return [x.decode("utf-8", "surrogatepass") for x in text.encode("utf-8", "surrogatepass").translate(_SPACE).split(b" ") if x]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of every text, and how many words each text has."""
    buf = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], _WORD[buf], [False]]).astype(np.int8)))
    a, b = edge[::2], edge[1::2]
    n = len(buf)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _MULT)]))
    inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INV)]))
    total = np.concatenate([[np.uint64(0)], np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[:-1])])
    h = _mix((total[b] - total[a]) * inverse[a])
    ends = np.cumsum([len(r) + 1 for r in raws])
    count = np.diff(np.concatenate([[0], np.searchsorted(a, ends)]))
    return h, count


def segments(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: index of the text, first window, number of windows, anchor."""
    h, count = word_hashes(raws)
    if len(h) < WINDOW:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    run = h[: len(h) - RUN + 1].copy()
    for k in range(1, RUN):
        run = run * _MULT + h[k : len(h) - RUN + 1 + k]
    run = _mix(run)
    span, low = WINDOW - RUN + 1, run
    low = np.minimum(low[:-1], low[1:])
    low = np.minimum(low[:-2], low[2:])
    low = np.minimum(low[:-4], low[4:])  # of 8
    low = np.minimum(low[: len(run) - span + 1], low[span - 8 : span - 8 + len(run) - span + 1])
    owner = np.repeat(np.arange(len(raws)), count)
    first = np.cumsum(count) - count
    ok = owner[: len(low)] == owner[WINDOW - 1 :]
    at = np.flatnonzero(ok)
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    new = np.concatenate([[True], (low[at[1:]] != low[at[:-1]]) | (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])])
    head = np.flatnonzero(new)
    size = np.diff(np.concatenate([head, [len(at)]]))
    text = owner[at[head]]
    return text, at[head] - first[text], size, low[at[head]].view(np.int64)


def _raw(texts: pd.Series) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def _anchors(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in it:
        text, first, _, anchor = segments(_raw(b["text"]))
        yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[text], "rid": b["rid"].to_numpy()[text], "anchor": anchor, "first": first.astype(np.int32)})


def _cut(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The marked segments with their words, and whether their anchor is hot."""
    for b in it:
        text, first, size, anchor = segments(_raw(b["text"]))
        marked = [set(x) for x in b["cold"]]
        hot = [set(x) for x in b["hot"]]
        w: dict[int, list[str]] = {}
        rows = []
        ids, rids, texts = b["doc_id"].to_numpy(), b["rid"].to_numpy(), b["text"].to_numpy()
        for t, f, n, a in zip(text.tolist(), first.tolist(), size.tolist(), anchor.tolist(), strict=True):
            if f in marked[t] or f in hot[t]:
                if t not in w:
                    w[t] = words(texts[t])
                rows.append((ids[t], rids[t], a, f, " ".join(w[t][f : f + n + WINDOW - 1]), f in hot[t]))
        yield pd.DataFrame(rows, columns=["doc_id", "rid", "anchor", "first", "words", "hot"]).astype({"doc_id": "int64", "rid": "int64", "anchor": "int64", "first": "int32", "words": object, "hot": bool})


class Block:
    """A reference block: segments of earlier documents, indexed by window."""

    def __init__(self) -> None:
        self.index: dict[tuple[str, ...], tuple[int, list[str], int]] = {}

    def factor(self, doc: int, w: list[str]) -> list[tuple[int, int]]:
        """Spans (begin, end) of w found in smaller documents; then w is indexed. Documents come in order."""
        spans, i, last = [], 0, len(w) - WINDOW
        while i <= last:
            key = tuple(w[i : i + WINDOW])
            hit = self.index.setdefault(key, (doc, w, i))
            if hit[0] < doc:
                ref, k, n = hit[1], hit[2], WINDOW
                while i + n < len(w) and k + n < len(ref) and w[i + n] == ref[k + n]:
                    n += 1
                spans.append((i, i + n))
                i += n - WINDOW  # the windows inside the factor are duplicates; those across its end come next
            i += 1
        return spans


def _parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by anchor, doc_id and first; a block lives as long as its anchor lasts."""
    now, block = None, Block()
    for b in it:
        rows = []
        for doc, rid, anchor, first, text in zip(b["doc_id"].tolist(), b["rid"].tolist(), b["anchor"].tolist(), b["first"].tolist(), b["words"], strict=True):
            if anchor != now:
                now, block = anchor, Block()
            rows += [(doc, rid, first + a, first + z) for a, z in block.factor(doc, text.split(" "))]
        yield pd.DataFrame(rows, columns=["doc_id", "rid", "begin", "end"]).astype({"doc_id": "int64", "rid": "int64", "begin": "int32", "end": "int32"})


def duplicate_spans(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, rid, begin, end): the word spans, as two arrays, covered by windows of smaller documents. rid tells rows
    with one id and different texts apart."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("rid"))
    anchors = staged(docs.mapInPandas(_anchors, "doc_id long, rid long, anchor long, first int"), "anchors")
    # steps of their own, so that the shuffle files of each go before the next one writes its own
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count(F.lit(1)).alias("n"))
    shared = staged(shared.where("a < b").select("anchor", (F.col("n") > HOT).alias("hot")), "shared")
    release(spark)
    marks = anchors.join(shared, "anchor").groupBy("doc_id", "rid").agg(
        F.collect_set(F.when(~F.col("hot"), F.col("first"))).alias("cold"), F.collect_set(F.when(F.col("hot"), F.col("first"))).alias("hot")
    )
    marks = staged(marks, "marks")
    discard(anchors, shared)
    release(spark)
    cut = docs.join(marks, ["doc_id", "rid"]).select("doc_id", "rid", "text", "cold", "hot").mapInPandas(_cut, "doc_id long, rid long, anchor long, first int, words string, hot boolean")
    cut = staged(cut, "segments")
    discard(marks)
    release(spark)
    n = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cold = cut.where("not hot").repartition(n, "anchor").sortWithinPartitions("anchor", "doc_id", "first").select("doc_id", "rid", "anchor", "first", "words")
    spans = cold.mapInPandas(_parse, "doc_id long, rid long, begin int, end int")
    every = spans.unionByName(_hot_spans(cut.where("hot"))).groupBy("doc_id", "rid").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    return every.mapInPandas(_merge, "doc_id long, rid long, begin array<int>, end array<int>")


def _hot_spans(hot: DataFrame) -> DataFrame:
    """(doc_id, rid, begin, end) for segments of hot anchors."""
    hot = hot.select("doc_id", "rid", "first", "words", F.sha2("words", 256).alias("c"))
    one = hot.groupBy("c").agg(F.min("doc_id").alias("least"), F.first("words").alias("words"))
    w = F.split("words", " ")
    cuts = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.struct(i.alias("i"), F.sha2(F.array_join(F.slice(w, i + 1, WINDOW), " "), 256).alias("h")))
    windows = one.select("c", "least", F.explode(cuts).alias("x")).select("c", "least", "x.i", "x.h")
    low = windows.groupBy("h").agg(F.min("least").alias("low"), F.max("least").alias("most")).where("low < most").select("h", "low")
    hits = windows.join(low, "h").where("least > low").groupBy("c").agg(F.collect_set("i").alias("at"))
    known = one.select("c", "least").join(hits, "c", "left")
    whole = F.array(F.struct(F.col("first").alias("begin"), (F.col("first") + F.size(w)).alias("end")))
    some = F.transform("at", lambda i: F.struct((F.col("first") + i).alias("begin"), (F.col("first") + i + WINDOW).alias("end")))
    got = hot.join(known, "c").where("doc_id > least or at is not null").select("doc_id", "rid", F.explode(F.when(F.col("doc_id") > F.col("least"), whole).otherwise(some)).alias("s"))
    return got.select("doc_id", "rid", "s.begin", "s.end")


def _merge(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The spans of a document, joined where they meet."""
    for b in it:
        begins, ends = [], []
        for spans in b["spans"]:
            x, y = [], []
            for a, z in sorted((s["begin"], s["end"]) for s in spans):
                if y and a <= y[-1]:
                    y[-1] = max(y[-1], z)
                else:
                    x.append(a)
                    y.append(z)
            begins.append(x)
            ends.append(y)
        yield pd.DataFrame({"doc_id": b["doc_id"], "rid": b["rid"], "begin": begins, "end": ends})


def remove_duplicates(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) with a column _kept: struct(n_words, n_removed, text), the kept words joined by a space."""
    spark = docs.sparkSession
    spans = staged(duplicate_spans(docs).toDF("d", "r", "begin", "end"), "spans")
    release(spark)

    @F.pandas_udf("n_words long, n_removed long, text string")
    def keep(text: pd.Series, begin: pd.Series, end: pd.Series) -> pd.DataFrame:
        rows = []
        for t, a, b in zip(text, begin, end, strict=True):
            w = words(t) if isinstance(t, str) else []
            gone = np.zeros(len(w) + 1, np.int64)
            if a is not None:
                gone[a] += 1  # spans don't meet, so no index comes twice
                gone[b] -= 1
            gone = np.cumsum(gone[:-1]) > 0
            rows.append((len(w), int(gone.sum()), " ".join(x for x, g in zip(w, gone.tolist(), strict=True) if not g)))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "text"])

    small_batches(spark)
    names = fresh(docs, "d", "r", "begin", "end", "rid")
    spans = spans.toDF(*names[:4])
    d, r, begin, end, rid = names
    got = docs.withColumn(rid, F.xxhash64("doc_id", "text"))
    got = got.join(spans, (F.col("doc_id").cast("long") == F.col(d)) & (F.col(rid) == F.col(r)), "left")
    return got.withColumn("_kept", keep("text", begin, end)).select(*[f"`{c}`" for c in docs.columns if c != "_kept"], "_kept")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = remove_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "_kept.n_words", "_kept.n_removed", F.sha2("_kept.text", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int | None, str | None]]) -> dict:
    """What op7 returns, window by window; for tests."""
    least: dict[tuple, int] = {}
    split = [(d, words(t)) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - WINDOW + 1) if d is not None else ():
            k = tuple(w[i : i + WINDOW])
            least[k] = min(least.get(k, d), d)
    out = {}
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - WINDOW + 1) if d is not None else ():
            if least[tuple(w[i : i + WINDOW])] < d:
                gone[i : i + WINDOW] = [True] * WINDOW
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out
