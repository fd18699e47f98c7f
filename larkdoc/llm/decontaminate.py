"""Benchmark decontamination: one Aho-Corasick automaton over the windows of the normalised
test texts, whose symbols are words; a document is scanned once and hits are mapped back to
its own words and offsets.

Normalisation lower-cases A-Z; words are runs of letters, digits and bytes above 127.
Defined results: null and empty texts have no words; an item of no words gives no window;
items repeated or with equal windows all count; items with a null id mark words but aren't
listed; repeated documents get equal results; extra columns pass through; an empty benchmark
leaves everything clean. A benchmark larger than one block is scanned block by block, all of it."""

from __future__ import annotations

import hashlib
from itertools import repeat

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, small_batches, table

WINDOW = 10
BLOCK_WORDS = 200_000  # of the benchmark in one automaton, which then takes some 100 MB at most
_MAP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_IS_WORD = np.array([_MAP[c] != 32 for c in range(256)])


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_MAP).split() if text else []


def word_offsets(text: str) -> np.ndarray:
    """Begin and end of each word in the original text, in bytes of UTF-8: an (n, 2) array."""
    inside = _IS_WORD[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    return edge.reshape(-1, 2)


class Scanner:
    """The automaton of some items."""

    def __init__(self, items: list[tuple[int | None, str | None]]) -> None:
        self.ids: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set] = {}
        for item, text in items:
            w = tuple(self.ids.setdefault(x, len(self.ids) + 1) for x in words(text))
            for i in range(max(1, len(w) - WINDOW + 1)) if w else ():
                owners.setdefault(w[i : i + WINDOW], set()).add(item)
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, who in owners.items():
            self.auto.add_word(key, (len(key), who))
        self.any = bool(owners)
        if self.any:
            self.auto.make_automaton()

    def scan(self, w: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words are hit, and the items with windows that occur."""
        hit, who = np.zeros(len(w) + 1, np.int64), set()
        if self.any and w:
            for end, (n, items) in self.auto.iter(tuple(map(self.ids.get, w, repeat(0)))):
                hit[end - n + 1] += 1
                hit[end + 1] -= 1
                who |= items
        return np.cumsum(hit[:-1]) > 0, who


_BUILT: dict[str, Scanner] = {}


def _scanner(block: list) -> Scanner:
    key = hashlib.sha256(repr(block).encode("utf-8", "surrogatepass")).hexdigest()
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Scanner(block)
    return _BUILT[key]


def blocks(benchmark: DataFrame) -> list[list[tuple]]:
    """The items, in blocks of at most BLOCK_WORDS words (an item with more is a block)."""
    out: list[list[tuple]] = [[]]
    held = 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        n = len(words(r.text))
        if held and held + n > BLOCK_WORDS:
            out.append([])
            held = 0
        out[-1].append((r.item_id, r.text))
        held += n
    return out


def scan(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, name: str = "_scan") -> DataFrame:
    """docs with a column name: struct(n_words, n_hit, n_items, items_sha256, spans); spans are
    (begin, end) of hit runs in bytes of the original text."""
    small_batches(spark)
    state = F.lit(None).cast("struct<hit: binary, items: array<string>>")
    for block in blocks(benchmark):
        state = _pass(spark.sparkContext.broadcast(block), F.col("text"), state)

    @F.pandas_udf("n_words long, n_hit long, n_items long, items_sha256 string, spans array<struct<begin: long, end: long>>")
    def report(text: pd.Series, found: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for t, h, items in zip(text, found["hit"], found["items"], strict=True):
            hit = np.frombuffer(h, np.uint8) > 0
            spans = []
            if hit.any():
                at = word_offsets(t)
                edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).reshape(-1, 2)
                spans = [{"begin": int(at[a][0]), "end": int(at[b - 1][1])} for a, b in edge]
            rows.append((len(hit), int(hit.sum()), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), spans))
        return pd.DataFrame(rows, columns=["n_words", "n_hit", "n_items", "items_sha256", "spans"])

    return docs.withColumn(name, report(F.col("text"), state))


def _pass(block, text: Column, state: Column) -> Column:
    @F.pandas_udf("hit binary, items array<string>")
    def one(text: pd.Series, before: pd.DataFrame) -> pd.DataFrame:
        scanner, rows = _scanner(block.value), []
        for t, h, items in zip(text, before["hit"], before["items"], strict=True):
            hit, who = scanner.scan(words(t))
            who = {str(x) for x in who if x is not None}
            if h is not None:
                hit, who = hit | (np.frombuffer(h, np.uint8) > 0), who | set(items)
            rows.append((hit.astype(np.uint8).tobytes(), sorted(who)))
        return pd.DataFrame(rows, columns=["hit", "items"])

    return one(text, state)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "_scan.n_words", "_scan.n_hit", "_scan.n_items", "_scan.items_sha256", (F.col("_scan.n_hit") > 0).alias("contaminated"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents in which no window of the benchmark occurs."""
    name, = fresh(docs, "_scan")
    return scan(spark, docs, benchmark, name).where(F.col(f"{name}.n_hit") == 0).drop(name)


OP6_SQL = r"""
WITH it AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), wn AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS g
  FROM it, LATERAL unnest(range(1, greatest(1, len(w) - 9) + 1)) AS u(i) WHERE len(w) > 0
), lens AS (SELECT DISTINCT n FROM wn), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), dw AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM d, lens, LATERAL unnest(range(1, len(w) - n + 2)) AS u(i)
), m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN wn ON dw.g = wn.g AND dw.n = wn.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)
"""
