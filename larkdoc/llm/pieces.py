"""SentencePiece encoding and decoding by suffix-array matching.

The text is normalised as the model says (a space becomes U+2581, one in front), and cut before
every run of U+2581, which no piece crosses. The distinct chunks of a batch are concatenated and
their suffixes sorted; binary search gives every piece its range of suffixes, that is all its
occurrences. Occurrences are edges; sorted by position they are relaxed from left to right: an edge
extends the paths that end where it begins and whose last piece can stand before it, which is when
merging the two pieces' characters gives the two pieces again. Any two neighbours in a merged text
are such, and one path of such neighbours is left at the end of a chunk; should there be several,
the chunk is merged directly. Characters without a piece fall back to bytes.

Defined results: a null text has null ids, an empty text none; repeated rows get equal ids; extra
columns pass through; a text is never cut short. Decoding gives back the text, but for U+2581
itself, which the format can't tell from a space."""

from __future__ import annotations

import heapq
import re
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "\u2581"
KNOWN = 300_000  # chunks whose ids a worker keeps
INDEX = 250_000  # characters of an index; its edges take some hundred times as many bytes
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


class Pieces:
    """Vocabulary and matching of one BPE model with byte fallback."""

    def __init__(self, proto: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.rank = {self.piece[i]: (-sp.get_score(i), i) for i in normal}
        self.byte = {int(self.piece[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unbyte = {i: b for b, i in self.byte.items()}
        self.unknown = sp.unk_id()
        if any(MARK in p.strip(MARK) or p.endswith(MARK) and p.strip(MARK) for p in self.rank):
            raise ValueError("a piece crosses a word's beginning")
        raw = sorted((p.encode(), i) for p, (_, i) in self.rank.items())
        pad = np.array([list(r[:16].ljust(16, b"\x00")) + list(r[:16].ljust(16, b"\xff")) for r, _ in raw], np.uint8).view(">u8").astype(np.uint64)
        self.low, self.high = pad[:, :2], pad[:, 2:]
        self.number = np.array([i for _, i in raw])
        self.size = np.array([len(r) for r, _ in raw])
        self.long = [(k, r) for k, (r, _) in enumerate(raw) if len(r) > 16]
        self.none = n  # stands for a character without a piece
        self.lengths = np.zeros(n + 1, np.int64)
        self.lengths[self.number] = self.size
        self.pair_keys = np.full(1 << 21, -1, np.int64)  # which pieces can stand side by side, as far as asked
        self.pair_fits = np.zeros(1 << 21, bool)
        self.known: dict[str, bytes] = {}
        self.bytes = [bytes([self.unbyte[i]]) if i in self.unbyte else q.encode() for i, q in enumerate(self.piece)]

    def merge(self, chunk: str) -> list[int]:
        """The ids of a chunk by merging its best neighbours, again and again."""
        sym: list[str | None] = list(chunk)
        left, right = list(range(-1, len(sym) - 1)), [*range(1, len(sym)), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int) -> None:
            b = right[a] if a >= 0 else -1
            if b >= 0 and (r := self.rank.get(sym[a] + sym[b])):
                heapq.heappush(heap, (r[0], a, b, sym[a] + sym[b]))

        for a in range(len(sym) - 1):
            offer(a)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if sym[a] is None or sym[b] is None or right[a] != b or sym[a] + sym[b] != both:
                continue
            sym[a], sym[b], right[a] = both, None, right[b]
            if right[a] >= 0:
                left[right[a]] = a
            offer(left[a])
            offer(a)
        return [i for s in sym if s is not None for i in self._ids(s)]

    def _ids(self, s: str) -> list[int]:
        if s in self.rank:
            return [self.rank[s][1]]
        return [self.byte[b] for b in s.encode("utf-8", "surrogatepass")] if self.byte else [self.unknown]

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece b can follow piece a: merging their characters gives both again."""
        key = a * (self.none + 1) + b
        slot = (key * 0x9E3779B1 >> 7) & (len(self.pair_keys) - 1)
        out = self.pair_fits[slot]
        free = (a < 0) | (a == self.none) | (b == self.none)
        miss = np.flatnonzero((self.pair_keys[slot] != key) & ~free)
        if len(miss):
            asked, where = np.unique(key[miss], return_inverse=True)
            pairs = [divmod(k, self.none + 1) for k in asked.tolist()]
            got = np.array([self.merge(self.piece[x] + self.piece[y]) == [x, y] for x, y in pairs], bool)
            out[miss] = got[where]
            self.pair_keys[slot[miss]], self.pair_fits[slot[miss]] = key[miss], out[miss]
        out[free] = True
        return out

    def match(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All occurrences of all pieces in concatenated chunks: positions, sizes, piece ids."""
        n = len(text)
        text = np.concatenate([np.where(text == 0, 255, text).astype(np.uint8), np.zeros(64, np.uint8)])
        first = np.lib.stride_tricks.as_strided(text, (n + 8, 8), (1, 1)).copy().view(">u8").ravel().astype(np.uint64)
        order = np.lexsort((first[8:], first[:n]))
        one, two = first[:n][order], first[8:][order]
        bounds = []
        for key, side in ((self.low, "left"), (self.high, "right")):
            near, far = np.searchsorted(one, key[:, 0], "left"), np.searchsorted(one, key[:, 0], "right")
            at = near if side == "left" else far
            for k in np.flatnonzero((self.size > 8) & (near < far)):  # those that begin like the piece, by their second half
                at[k] = near[k] + np.searchsorted(two[near[k] : far[k]], key[k, 1], side)
            bounds.append(at)
        a, b = bounds
        n = np.maximum(b - a, 0)
        at = order[np.repeat(a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        size, who = np.repeat(self.size, n), np.repeat(self.number, n)
        keep = np.ones(len(at), bool)
        ends = np.cumsum(n)
        for k, r in self.long:  # beyond 16 bytes every occurrence is compared
            for j in range(ends[k] - n[k], ends[k]):
                keep[j] = text[at[j] : at[j] + len(r)].tobytes() == r
        return at[keep], size[keep], who[keep]

    def learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks as 32-bit numbers, all in one index; edges are relaxed from left to right in all chunks at a time."""
        if not chunks:
            return {}
        raw = [c.encode("utf-8", "surrogatepass") for c in chunks]
        text = np.frombuffer(b"\xfe".join(raw) + b"\xfe", np.uint8)
        size = np.array([len(r) for r in raw])
        start = np.cumsum(size + 1) - size - 1
        owner = np.repeat(np.arange(len(raw)), size + 1)
        at, width, who = self.match(text)
        lead = np.flatnonzero((text & 0xC0 != 0x80) & (text != 0xFE))
        char = np.array([1] * 192 + [2] * 32 + [3] * 16 + [4] * 16)[text[lead]]
        alone = np.zeros(len(text), bool)
        is_char = np.zeros(len(text), np.int64)
        is_char[lead] = char
        alone[at[width == is_char[at]]] = True
        bare = ~alone[lead]
        at, width, who = (np.concatenate(x) for x in ((at, lead[bare]), (width, char[bare]), (who, np.full(int(bare.sum()), self.none))))
        place = at - start[owner[at]]
        by = np.argsort(place.astype(np.uint16) if place.max(initial=0) < 65536 else place, kind="stable")
        at, width, who, place = at[by], width[by], who[by], place[by]
        last = np.full(len(text), -9, np.int64)  # the last piece of the path that ends here
        back = np.zeros(len(text), np.int64)
        many = np.zeros(len(text), bool)
        last[start] = -1
        cuts = np.flatnonzero(np.diff(place, prepend=-1))
        for i, j in zip(cuts, [*cuts[1:], len(place)], strict=True):
            reached = last[at[i:j]]
            ok = reached != -9
            a, n, w = at[i:j][ok], width[i:j][ok], who[i:j][ok]
            ok = self._fits(reached[ok], w)
            a, n, w = a[ok], n[ok], w[ok]
            to = a + n
            many[to] |= last[to] != -9
            last[to], back[to] = w, n
        got: list[bytes | None] = [b""] * len(raw)
        for k in np.unique(np.concatenate([owner[np.flatnonzero(many)], np.flatnonzero(last[start + size] == -9)])):
            got[k] = None  # more than one path came together: merge it directly
        live = np.array([k for k, x in enumerate(got) if x is not None], np.int64)
        pos, found = (start + size)[live], []
        while len(live):
            found.append((live, pos - back[pos], last[pos]))
            pos = pos - back[pos]
            on = pos > start[live]
            live, pos = live[on], pos[on]
        if found:
            k, p, w = (np.concatenate(x) for x in zip(*found, strict=True))
            by = np.argsort(p)
            k, p, w = k[by], p[by], w[by]
            if (w == self.none).any():  # bytes for characters without a piece
                n = np.where(w == self.none, is_char[p] if self.byte else 1, 1)
                k, p = np.repeat(k, n), np.repeat(p, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                w = np.repeat(w, n)
                table = np.array([self.byte.get(b, self.unknown) for b in range(256)])
                w = np.where(w == self.none, table[text[p]], w)
            ids, ends = w.astype("<i4").tobytes(), (4 * np.searchsorted(k, np.arange(len(raw)), "right")).tolist()
            begin = 0
            for j, end in enumerate(ends):
                if got[j] is not None:
                    got[j] = ids[begin:end]
                begin = end
        return {c: np.array(self.merge(c), "<i4").tobytes() if g is None else g for c, g in zip(chunks, got, strict=True)}

    @staticmethod
    def chunks(text: str) -> list[str]:
        """U+2581 in front and for spaces, cut before every run of it. Empty texts have no chunks."""
        return _CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        cut = [self.chunks(t) if t is not None else None for t in texts]
        new = dict.fromkeys(chain.from_iterable(x for x in cut if x))
        new = [c for c in new if c not in self.known]
        todo, size = [], 0
        if len(self.known) + len(new) > KNOWN:
            self.known = {c: self.known[c] for x in cut if x for c in x if c in self.known}
        for c in [*new, None]:  # indexes of bounded size
            if c is None or size > INDEX:
                self.known.update(self.learn(todo))
                todo, size = [], 0
            if c is not None:
                todo.append(c)
                size += len(c) + 1
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, x)), "<i4") if x is not None else None for x in cut]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


_LOADED: dict[int, Pieces] = {}


def pieces(proto: bytes) -> Pieces:
    key = hash(proto)
    if key not in _LOADED:
        _LOADED[key] = Pieces(proto)
    return _LOADED[key]


def _model(spark: SparkSession, path: str):
    with open(path, "rb") as f:  # the tokenizer's file lies on the driver's machine and is half a megabyte
        return spark.sparkContext.broadcast(f.read())


def encode_column(spark: SparkSession, text: Column, path: str = MODEL) -> Column:
    """array<int> of piece ids."""
    small_batches(spark)
    proto = _model(spark, path)

    @F.pandas_udf("array<int>")
    def encode(s: pd.Series) -> pd.Series:
        got = pieces(proto.value).encode([t if isinstance(t, str) else None for t in s])
        return pd.Series(got, dtype=object)

    return encode(text)


def decode_column(spark: SparkSession, ids: Column, path: str = MODEL) -> Column:
    small_batches(spark)
    proto = _model(spark, path)

    @F.pandas_udf("string")
    def decode(s: pd.Series) -> pd.Series:
        m = pieces(proto.value)
        return pd.Series([m.decode(x.tolist()) if x is not None else None for x in s], dtype=object)

    return decode(ids)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every whole text, and whether they decode to it again."""
    small_batches(spark)
    proto = _model(spark, MODEL)

    @F.pandas_udf("n_tokens long, ids_sha256 string, same boolean")
    def both(s: pd.Series) -> pd.DataFrame:
        import hashlib

        m, rows = pieces(proto.value), []
        for t, ids in zip(s, m.encode([t if isinstance(t, str) else None for t in s]), strict=True):
            if ids is None:
                rows.append((None, None, None))
            else:
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), m.decode(ids.tolist()) == t.replace(MARK, " ")))
        out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "same"])
        return out.astype({"n_tokens": "Int64", "same": "boolean"})

    got = table(spark, sf_dir, "documents").select("doc_id", both("text").alias("p"))
    return got.select("doc_id", "p.n_tokens", "p.ids_sha256", F.col("p.same").alias("round_trip"))


def tokenized(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, ids, their number, and the text decoded from them."""
    got = docs.select("doc_id", encode_column(spark, F.col("text")).alias("ids"))
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", decode_column(spark, F.col("ids")).alias("decoded"))
