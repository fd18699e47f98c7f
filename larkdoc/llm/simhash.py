"""SimHash near-duplicates with pivot distance tables.

Every text has a 64-bit fingerprint by majority over the XXH64 of its word shingles; texts
link where fingerprints differ in at most 4 bits, and classes are the components of links.
Texts with one fingerprint are one node. The Hamming distances to many reference fingerprints are worked out
once a node and travel with it. Fingerprints within 4 bits agree on at least one of
five blocks of bits, so nodes are dealt by (block, bits) and no link is lost. The rest of the bits of two nodes
in a bucket differs in 4 at most as well, so a bucket of very many nodes is dealt again by five blocks of that
rest: keys have 12, 22 or 30 bits, as many as the data needs. A bucket is sorted by the
first distance, and pairs whose distances to any reference differ by more than 4 can't link (triangle
inequality) and are discarded; survivors are verified on the fingerprints. A bucket passes on
a spanning forest, not its pairs. Buckets that are large even by the longest keys hold nodes that are near each other; they are cut into chunks, and every
pair of chunks is a task of its own, so no task holds more than two chunks.

Defined results: null and empty texts and texts without words have fingerprint zero and link like
any other; rows with one doc_id are one document for classes; the class of a row without doc_id
is the smallest id of its class (null if it has none); extra columns pass through the operator, whatever
their names. Of rows with one doc_id that stays, the one with the least text stays (null first, then bytes;
of equal texts the one whose other columns have the least hash)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, staged, table
from .components import connected_components

SHINGLE = 4
BITS = 4  # linked fingerprints differ in this many bits at most
CHUNK = 2048  # nodes of a hot bucket in one chunk
PIVOTS = 32
PIECES = BITS + 1  # blocks of bits: by the pigeonhole principle one is equal in linked fingerprints
LEVELS = 3  # how often a bucket of many nodes is dealt again
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = bytes(32 if 9 <= c <= 13 else c for c in range(256))
_REFERENCES = np.random.default_rng(64).integers(0, 2**64, PIVOTS, np.uint64)
_TABLE = [f"p{k}" for k in range(PIVOTS // 8)]


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    raw = text.encode("utf-8", "surrogatepass").translate(_LOWER).translate(_SPACE) if text else b""
    w = [x for x in raw.split(b" ") if x]
    if not w:
        return 0
    flat, n = b" ".join(w), max(1, len(w) - SHINGLE + 1)
    ends, at = [], 0
    for x in w:
        at += len(x) + 1
        ends.append(at)
    begins = [0, *ends[: n - 1]]
    stops = ends[SHINGLE - 1 :] if len(w) >= SHINGLE else [at]
    digest = xxhash.xxh64_intdigest
    set_bits = np.zeros(64, np.int64)
    for k in range(0, n, 65536):
        h = np.array([digest(flat[a : b - 1], 42) for a, b in zip(begins[k : k + 65536], stops[k : k + 65536], strict=True)], dtype=">u8")
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > n).tobytes(), "big")


def fingerprint_column(spark: SparkSession, text: Column) -> Column:
    """The fingerprint's 64 bits as a (signed) long."""
    small_batches(spark)

    @F.pandas_udf("long")
    def fp(s: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in s], np.uint64).view(np.int64))

    return fp(text)


def distances(fp: Column) -> list[Column]:
    """The distances to the references, eight in a number, a byte each."""
    refs = _REFERENCES.view(np.int64).tolist()
    return [reduce(Column.bitwiseOR, [F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(r))).cast("long"), 8 * i) for i, r in enumerate(refs[8 * k : 8 * k + 8])]).alias(c) for k, c in enumerate(_TABLE)]


def table_of(fp: np.ndarray) -> np.ndarray:
    """The same distances, a row a fingerprint."""
    return np.stack([np.bitwise_count(fp ^ r) for r in _REFERENCES], 1).astype(np.int8)


def bucket_links(key: np.ndarray, fp: np.ndarray, chunk: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between fingerprints of one key within BITS bits. Rows come sorted by key.

    chunk is 0, or 1 and 2 for the two chunks of a task that looks only at pairs between them; pivots has
    the distances to the references."""
    none = np.zeros(0, np.int64)
    if len(key) < 2:
        return none, none
    order = np.lexsort((pivots[:, 0], key))
    key, fp, chunk, pivots = key[order], fp[order], chunk[order], pivots[order]
    first = pivots[:, 0].astype(np.int64)
    alive = np.flatnonzero((key[1:] == key[:-1]) & (first[1:] - first[:-1] <= BITS))
    if not len(alive):
        return none, none
    lab, n, d = np.arange(len(key)), len(key), 1
    while len(alive):
        i, j = alive, alive + d
        new = (lab[i] != lab[j]) & ((chunk[i] != chunk[j]) | (chunk[i] == 0))
        i, j = i[new], j[new]
        for c in range(0, PIVOTS, 8):  # the maximum coordinate difference, a few columns at a time
            if not len(i):
                break
            near = (np.abs(pivots[i, c : c + 8] - pivots[j, c : c + 8]) <= BITS).all(1)
            i, j = i[near], j[near]
        linked = np.bitwise_count(fp[i] ^ fp[j]) <= BITS
        if linked.any():
            for a, b in zip(i[linked].tolist(), j[linked].tolist(), strict=True):
                while lab[a] != a:
                    a = lab[a]
                while lab[b] != b:
                    b = lab[b]
                lab[max(a, b)] = min(a, b)
            while True:
                up = lab[lab]
                if (up == lab).all():
                    break
                lab = up
        d += 1
        alive = alive[alive + d < n]
        alive = alive[(key[alive + d] == key[alive]) & (first[alive + d] - first[alive] <= BITS)]
    moved = np.flatnonzero(lab != np.arange(n))
    return fp.view(np.int64)[moved], fp.view(np.int64)[lab[moved]]


_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole keys of a partition sorted by key, some at a time."""
    held: list[pa.RecordBatch] = []
    size = 0

    def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
        pivots = np.stack([t[c].to_numpy() for c in _TABLE], 1).view(np.int8)
        u, v = bucket_links(t["key"].to_numpy(), t["fp"].to_numpy().view(np.uint64), t["chunk"].to_numpy().astype(np.int8), pivots)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=_LINKS)

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size >= 50_000:
            t = pa.Table.from_batches(held)
            keys = t["key"].to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
            if cut:
                yield from out(t.slice(0, cut))
                held, size = t.slice(cut).combine_chunks().to_batches(), len(keys) - cut
    if held:
        yield from out(pa.Table.from_batches(held))


def _dealt(rows: DataFrame) -> DataFrame:
    """rows(key, rest, width, fp, ...) by each of PIECES blocks of the rest's width bits: the block goes into the key and out of the rest."""
    a = [f"cast(floor({k} * width / {PIECES}) as int)" for k in range(PIECES + 1)]
    cuts = ", ".join(
        f"struct(xxhash64(key, {k}, shiftrightunsigned(rest, {a[k]}) & (shiftleft(1L, {a[k + 1]} - {a[k]}) - 1)) as key, "
        f"(if({a[k + 1]} >= 64, 0L, shiftleft(shiftrightunsigned(rest, {a[k + 1]}), {a[k]})) | (rest & (shiftleft(1L, {a[k]}) - 1))) as rest, width - ({a[k + 1]} - {a[k]}) as width)"
        for k in range(PIECES)
    )
    return rows.select(F.expr(f"explode(array({cuts}))").alias("b"), "fp", *_TABLE).select("b.key", "b.rest", "b.width", "fp", *_TABLE)


def links(nodes: DataFrame) -> DataFrame:
    """Links (u, v) between distinct fingerprints in nodes(fp, p0, p1, ...), enough of them to span every component."""
    spark = nodes.sparkSession
    rows = _dealt(nodes.select(F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest"), F.lit(64).alias("width"), "fp", *_TABLE))
    cold = []
    for level in range(LEVELS):
        sizes = rows.groupBy("key").count().where("count > 1")
        last = level == LEVELS - 1
        some = rows.join(sizes if last else sizes.where(F.col("count") <= CHUNK), "key")
        if last:
            break
        cold.append(some.select("key", "fp", F.lit(0).alias("chunk"), *_TABLE))
        hot = staged(rows.join(sizes.where(F.col("count") > CHUNK).select("key"), "key", "left_semi"), "hot")
        if hot.isEmpty():
            break
        rows = _dealt(hot)
    if last:
        some = some.withColumn("chunks", F.ceil(F.col("count") / CHUNK).cast("int"))
        own = F.pmod(F.xxhash64("fp", F.lit(5)), F.col("chunks")).cast("int")
        pairs = F.transform(
            F.sequence(F.lit(0), F.col("chunks") - 1),
            lambda c: F.struct(
                F.xxhash64("key", F.least(own, c), F.greatest(own, c), F.lit(9)).alias("key"),
                F.when(c == own, 0).when(own < c, 1).otherwise(2).cast("int").alias("chunk"),
            ),
        )
        cold.append(some.select("fp", *_TABLE, F.explode(pairs).alias("p")).select("p.key", "fp", "p.chunk", *_TABLE))
    n = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return reduce(DataFrame.unionByName, cold).repartition(n, "key").sortWithinPartitions("key").mapInArrow(_tasks, "u long, v long")


def classes(fps: DataFrame) -> DataFrame:
    """fps(doc_id, fp), staged -> (fp, component_id): the smallest doc_id of all that the fingerprint reaches."""
    nodes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).select("fp", "rep", *distances(F.col("fp"))), "nodes")
    comp = connected_components(links(nodes.drop("rep"))).withColumnRenamed("node", "fp")
    comp = staged(nodes.select("fp", "rep").join(comp, "fp"), "members")
    least = comp.groupBy("component").agg(F.min("rep").alias("least"))
    low = comp.join(least, "component").select("fp", F.col("least").alias("low"))
    return nodes.join(low, "fp", "left").select("fp", F.coalesce("low", "rep").alias("component_id"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fps = staged(docs.select("doc_id", fingerprint_column(spark, F.col("text")).alias("fp")), "fps")
    got = fps.join(classes(fps), "fp")
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the smallest id, stays; of rows with one id one stays.

    Rows without an id can't be told apart and all stay."""
    fps = staged(docs.select("doc_id", fingerprint_column(spark, F.col("text")).alias("fp")), "fps")
    stay = classes(fps.where("doc_id is not null")).select(F.col("component_id").alias("doc_id")).distinct()
    rows = docs.where("doc_id is not null").select("doc_id", "text", F.struct(*[docs[c] for c in docs.columns]).alias("row")).join(stay, "doc_id", "left_semi")
    one = Window.partitionBy("doc_id").orderBy("text", F.xxhash64("row"))
    named = rows.withColumn("n", F.row_number().over(one)).where("n = 1").select("row.*")
    return named.unionByName(docs.where("doc_id is null"))
