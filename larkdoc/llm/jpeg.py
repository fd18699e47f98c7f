"""Baseline JPEG in numpy: marker parsing, Huffman decoding of the scans, and
thumbnails of the luminance's DC coefficients; and a writer that stores bytes as the
DC coefficients of a grey image, one byte for each 8 x 8 block.

The decoder keeps one lane for each restart segment of all images that share tables and
layout, and takes a Huffman symbol in every lane at a time, so its steps are numpy calls
over many segments. AC coefficients are skipped over, not kept.

Defined results: bytes that aren't a baseline JPEG give no thumbnails (null columns); a null
text is stored as an empty one; texts longer than one image holds become several images, one
after another; repeated rows get equal results; extra columns pass through."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

ROW = 192  # blocks in a row of the stored image; also its restart interval
MAX_ROWS = 8191  # of blocks, in one image
# Code counts by length and the values of the DC luminance table in annex K of the JPEG standard.
DC_COUNTS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
DC_VALUES = list(range(12))
# One AC symbol is enough for blocks without AC: end of block, as the code 0.
AC_COUNTS = [1] + [0] * 15
AC_VALUES = [0]


def codes(counts: list[int], values: list[int]) -> list[tuple[int, int, int]]:
    """(value, code, length) in canonical order."""
    out, code, k = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((values[k], code, length))
            code, k = code + 1, k + 1
        code <<= 1
    return out


def lookup(counts: list[int], values: list[int]) -> np.ndarray:
    """By the next 16 bits: length * 256 + value; 0 where no code fits."""
    out = np.zeros(65536, np.int64)
    for v, code, length in codes(counts, values):
        out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | v
    return out


def _words() -> tuple[np.ndarray, np.ndarray]:
    """The bits of a block by its DC difference + 255, with the end of block, and their number."""
    dc = {v: (c, n) for v, c, n in codes(DC_COUNTS, DC_VALUES)}
    word, bits = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = dc[size]
        extra = d if d >= 0 else d + (1 << size) - 1
        word[d + 255], bits[d + 255] = (code << size | extra) << 1, n + size + 1
    return word, bits


WORD, BITS = _words()


def _header(rows: int) -> bytes:
    def part(marker: int, body: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body

    return b"".join((
        b"\xff\xd8",
        part(0xDB, bytes([0, 8] + [1] * 63)),  # a DC step of 8 is one grey level
        part(0xC0, struct.pack(">BHHB", 8, rows * 8, ROW * 8, 1) + bytes([1, 0x11, 0])),
        part(0xC4, bytes([0x00, *DC_COUNTS, *DC_VALUES, 0x10, *AC_COUNTS, *AC_VALUES])),
        part(0xDD, struct.pack(">H", ROW)),
        part(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ))


def encode(payloads: list[bytes]) -> list[bytes]:
    """Each payload, a positive multiple of ROW bytes long, as one or more images."""
    if not payloads:
        return []
    for p in payloads:
        if not p or len(p) % ROW:
            raise ValueError(f"a payload has {len(p)} bytes, not a positive multiple of {ROW}")
    v = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW).astype(np.int64) - 128
    rows = np.array([len(p) // ROW for p in payloads])
    images = np.concatenate([np.array([MAX_ROWS] * (n // MAX_ROWS) + ([n % MAX_ROWS] if n % MAX_ROWS else [])) for n in rows])
    d = np.diff(v, axis=1, prepend=0) + 255
    word, bits = WORD[d], BITS[d]
    ends = bits.cumsum(1)
    size = -(-ends[:, -1] // 8)  # bytes of each segment
    first = np.cumsum(size) - size
    at = (first[:, None] * 8 + ends - bits).ravel()
    pad = size * 8 - ends[:, -1]
    at = np.concatenate([at, first * 8 + ends[:, -1]])
    word = np.concatenate([word.ravel(), (1 << pad) - 1])
    bits = np.concatenate([bits.ravel(), pad])
    word = word << (24 - bits - (at & 7))
    out = np.zeros(int(size.sum()) + 3)
    for k, shift in enumerate((16, 8, 0)):  # the words' bits don't overlap, so sums set them
        out += np.bincount((at >> 3) + k, (word >> shift) & 255, len(out))
    out = out[:-3].astype(np.uint8)
    last = np.cumsum(images) - 1
    within = np.arange(len(size)) - np.repeat(np.cumsum(images) - images, images)
    marked = np.ones(len(size), bool)
    marked[last] = False
    extra = (out == 255).astype(np.int64)
    seg_end = first + size - 1
    extra[seg_end[marked]] += 2
    place = np.cumsum(extra + 1) - extra - 1
    full = np.zeros(int((extra + 1).sum()), np.uint8)
    full[place] = out
    after = place[seg_end[marked]] + 1 + (out[seg_end[marked]] == 255)
    full[after] = 255
    full[after + 1] = 0xD0 + within[marked] % 8
    stop = place[seg_end[last]] + 1 + (out[seg_end[last]] == 255)
    start = np.concatenate([[0], stop[:-1]])
    raw = full.tobytes()
    frames = [_header(int(n)) + raw[a:b] + b"\xff\xd9" for n, a, b in zip(images, start, stop, strict=True)]
    done, k = [], 0
    for n in rows:
        m = -(-int(n) // MAX_ROWS)
        done.append(b"".join(frames[k : k + m]))
        k += m
    return done


class Unreadable(ValueError):
    """Not a baseline JPEG that this decoder reads."""


def parse(data: bytes) -> list[dict]:
    """Headers and scan bytes of every image in data."""
    images, i = [], 0
    while i < len(data):
        if data[i : i + 2] != b"\xff\xd8":
            raise Unreadable("no start of image")
        i += 2
        quant, huff, frame, interval, scan = {}, {}, None, 0, None
        while True:
            if i + 2 > len(data) or data[i] != 0xFF:
                raise Unreadable("no marker")
            m = data[i + 1]
            if m == 0xFF:
                i += 1
                continue
            if m == 0xD9:
                i += 2
                break
            n = int.from_bytes(data[i + 2 : i + 4], "big")
            if n < 2 or i + 2 + n > len(data):
                raise Unreadable("a segment is cut off")
            body = data[i + 4 : i + 2 + n]
            i += 2 + n
            try:
                if m == 0xDB:
                    while body:
                        wide = body[0] >> 4
                        quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                        body = body[1 + 64 * (wide + 1) :]
                elif m == 0xC4:
                    while body:
                        counts = list(body[1:17])
                        huff[body[0]] = (tuple(counts), tuple(body[17 : 17 + sum(counts)]))
                        body = body[17 + sum(counts) :]
                elif m == 0xDD:
                    interval = int.from_bytes(body[:2], "big")
                elif m == 0xC0:
                    if body[0] != 8:
                        raise Unreadable("samples aren't of 8 bits")
                    h, w = struct.unpack(">HH", body[1:5])
                    frame = (h, w, [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])])
                elif 0xC1 <= m <= 0xCF and m not in (0xC8, 0xCC):
                    raise Unreadable("not baseline")
                elif m == 0xDA:
                    if not frame:
                        raise Unreadable("a scan before its frame")
                    ids = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])}
                    raw = np.frombuffer(data, np.uint8, offset=i)
                    ff = np.flatnonzero(raw[:-1] == 255)
                    nxt = raw[ff + 1]
                    stop = ff[~((nxt == 0) | (nxt >= 0xD0) & (nxt <= 0xD7))]
                    if not len(stop):
                        raise Unreadable("the scan doesn't end")
                    stop = int(stop[0])
                    ff, nxt = ff[ff < stop], nxt[ff < stop]
                    cut = np.concatenate([ff[nxt != 0], [stop]])
                    begin = np.concatenate([[0], cut[:-1] + 2])
                    drop = np.ones(stop, bool)
                    drop[ff[nxt == 0] + 1] = False
                    gone = np.concatenate([[0], np.cumsum(~drop)])
                    if scan is None and frame[2][0][0] in ids:
                        scan = (ids, raw[:stop][drop], begin - gone[begin], cut - gone[cut])
                    i += stop
            except (IndexError, struct.error) as e:
                raise Unreadable("a segment is too short") from e
        if not frame or scan is None or not (frame[0] and frame[1]):
            raise Unreadable("no frame or no scan")
        images.append({"quant": quant, "huff": huff, "frame": frame, "interval": interval, "scan": scan})
    return images


def _plan(im: dict) -> tuple:
    """What decoding needs besides the bytes; equal for images that can share lanes."""
    _, _, parts = im["frame"]
    ids = im["scan"][0]
    used = [p for p in parts if p[0] in ids]
    try:
        tables = [(im["huff"][ids[p[0]][0]], im["huff"][16 + ids[p[0]][1]]) for p in used]
        step = im["quant"][parts[0][3]]
    except KeyError as e:
        raise Unreadable("a table is missing") from e
    alone = len(used) == 1
    blocks = tuple(k for k, p in enumerate(used) for _ in range(1 if alone else p[1] * p[2]))
    return tuple(tables), blocks, step


def _luma(plan: tuple, buf: np.ndarray, start: np.ndarray, stop: np.ndarray, mcus: np.ndarray) -> np.ndarray:
    """DC coefficients of the first component, a row for each lane, in the order of the scan."""
    tables, blocks, _ = plan
    lut = np.stack([lookup(list(c), list(v)) for t in tables for c, v in t])
    per, lumas = len(blocks), blocks.count(0)
    blocks = np.array(blocks)
    rank = np.cumsum(blocks == 0) - 1
    b = np.concatenate([buf, np.full(8, 255, np.uint8)]).astype(np.int64)
    w = b[:-4] << 32 | b[1:-3] << 24 | b[2:-2] << 16 | b[3:-1] << 8 | b[4:]
    out = np.zeros((len(start), int(mcus.max()) * lumas), np.int64)
    lane = np.arange(len(start))
    pos, end, todo = start * 8, stop * 8, mcus * per
    blk, k = np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64)
    pred = np.zeros((len(lane), int(blocks.max()) + 1), np.int64)
    while len(lane):
        comp = blocks[blk % per]
        got = lut[2 * comp + (k > 0), (w[pos >> 3] >> (24 - (pos & 7))) & 0xFFFF]
        length, symbol = got >> 8, got & 255
        size = np.where(k > 0, symbol & 15, symbol)
        at = pos + length
        if (length == 0).any() or (at + size > end).any() or (size > 15).any():
            raise Unreadable("the scan's bits are spoilt")
        dc = np.flatnonzero(k == 0)
        if len(dc):
            a, s = at[dc], size[dc]
            v = (w[a >> 3] >> (40 - (a & 7) - s)) & ((1 << s) - 1)
            v = np.where(v < (1 << np.maximum(s - 1, 0)), v - (1 << s) + 1, v) * (s > 0)
            c = comp[dc]
            pred[dc, c] += v
            y = dc[c == 0]
            out[lane[y], blk[y] // per * lumas + rank[blk[y] % per]] = pred[y, 0]
        k = np.where(k == 0, 1, np.where((symbol == 0), 64, k + (symbol >> 4) + 1))
        pos = at + size
        over = k >= 64
        if over.any():
            blk = blk + over
            k[over] = 0
            left = blk < todo
            if not left.all():
                lane, pos, end, todo, blk, k, pred = (x[left] for x in (lane, pos, end, todo, blk, k, pred))
    return out


def thumbnails(files: list[bytes | None]) -> list[list[np.ndarray] | None]:
    """For each file the DC thumbnails of its images, uint8 with a pixel for each luminance block; None if unreadable."""
    out: list[list | None] = []
    groups: dict[tuple, list] = {}
    for f in files:
        try:
            images = parse(f) if f else None
            plans = [_plan(im) for im in images] if images else []
        except Unreadable:
            images = None
        out.append([None] * len(images) if images else None)
        for k, im in enumerate(images or []):
            groups.setdefault(plans[k], []).append((len(out) - 1, k, im))
    for plan, members in groups.items():
        try:
            _fill(plan, members, out)
        except (Unreadable, IndexError):  # one spoilt file must not take the others along
            for m in members:
                try:
                    _fill(plan, [m], out)
                except (Unreadable, IndexError):
                    out[m[0]] = None
    return out


def _fill(plan: tuple, members: list, out: list) -> None:
    bufs, starts, stops, mcus, shapes, base = [], [], [], [], [], 0
    for _, _, im in members:
        h, w, parts = im["frame"]
        _, buf, a, b = im["scan"]
        hmax, vmax = max(p[1] for p in parts), max(p[2] for p in parts)
        fh, fv = parts[0][1], parts[0][2]
        by, bx = -(-(-(-h * fv // vmax)) // 8), -(-(-(-w * fh // hmax)) // 8)  # luminance blocks
        if len(plan[1]) == 1:
            my, mx, fh, fv = by, bx, 1, 1
        else:
            my, mx = -(-h // (8 * vmax)), -(-w // (8 * hmax))
        each = im["interval"] or my * mx
        n = -(-my * mx // each)
        if len(a) != n:
            raise Unreadable("restart markers don't fit")
        bufs.append(buf)
        starts.append(a + base)
        stops.append(b + base)
        mcus.append(np.minimum(each, my * mx - each * np.arange(n)))
        shapes.append((n, my, mx, fv, fh, by, bx))
        base += len(buf)
    dc = _luma(plan, np.concatenate(bufs), np.concatenate(starts), np.concatenate(stops), np.concatenate(mcus))
    grey = np.clip(np.rint(dc * plan[2] / 8) + 128, 0, 255).astype(np.uint8)
    row = 0
    for (f, k, _), m, (n, my, mx, fv, fh, by, bx) in zip(members, mcus, shapes, strict=True):
        flat = grey[row] if n == 1 else np.concatenate([grey[row + j, : c * fv * fh] for j, c in enumerate(m)]) if m[-1] != m[0] else grey[row : row + n, : m[0] * fv * fh].ravel()
        flat = flat[: my * mx * fv * fh].reshape(my, mx, fv, fh).transpose(0, 2, 1, 3).reshape(my * fv, mx * fh)
        if out[f] is not None:
            out[f][k] = flat[:by, :bx]
        row += n


def thumbnail_hash(t: np.ndarray) -> str:
    """Average hash: cells of an 8 x 8 grid against their mean, as 16 hex digits."""
    r, c = np.arange(9) * t.shape[0] // 8, np.arange(9) * t.shape[1] // 8
    s = np.zeros((t.shape[0] + 1, t.shape[1] + 1))
    s[1:, 1:] = t.astype(np.float64).cumsum(0).cumsum(1)
    r1, c1 = np.maximum(r[1:], r[:-1] + 1), np.maximum(c[1:], c[:-1] + 1)
    r1, c1 = np.minimum(r1, t.shape[0]), np.minimum(c1, t.shape[1])
    r0, c0 = np.minimum(r[:-1], r1 - 1), np.minimum(c[:-1], c1 - 1)
    cell = (s[np.ix_(r1, c1)] - s[np.ix_(r0, c1)] - s[np.ix_(r1, c0)] + s[np.ix_(r0, c0)]) / np.outer(r1 - r0, c1 - c0)
    return np.packbits((cell > cell.mean()).ravel()).tobytes().hex()


def media_columns(spark: SparkSession, media: Column) -> Column:
    """struct(width, height, images, thumb_width, thumb_height, thumb_sha256, thumb_hash) of JPEG bytes; dimensions and
    hash of the first image, the digest of all. Nulls where the bytes can't be read."""
    small_batches(spark)

    @F.pandas_udf("width int, height int, images int, thumb_width int, thumb_height int, thumb_sha256 string, thumb_hash string")
    def columns(s: pd.Series) -> pd.DataFrame:
        files = [bytes(x) if x is not None else None for x in s]
        rows = []
        for f, t in zip(files, thumbnails(files), strict=True):
            if not t:
                rows.append((None,) * 7)
                continue
            h, w, _ = parse(f)[0]["frame"]
            rows.append((w, h, len(t), t[0].shape[1], t[0].shape[0], hashlib.sha256(b"".join(x.tobytes() for x in t)).hexdigest(), thumbnail_hash(t[0])))
        out = pd.DataFrame(rows, columns=["width", "height", "images", "thumb_width", "thumb_height", "thumb_sha256", "thumb_hash"])
        return out.astype({c: "Int32" for c in out.columns[:5]})

    return columns(media)


def store_texts(spark: SparkSession, text: Column) -> Column:
    """The text's UTF-8 bytes, padded with spaces to a positive multiple of 192, as JPEG bytes."""
    small_batches(spark)

    @F.pandas_udf("binary")
    def store(s: pd.Series) -> pd.Series:
        raw = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in s]
        return pd.Series(encode([t + b" " * ((-len(t)) % ROW if t else ROW) for t in raw]), dtype=object)

    return store(text)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every text as a JPEG, read the stored bytes back and describe them."""
    small_batches(spark)

    @F.pandas_udf("payload_bytes long, payload_sha256 string, tail_crc32 long, width int, height int, thumb_hash string")
    def read_back(s: pd.Series) -> pd.DataFrame:
        files = [bytes(x) for x in s]
        rows = []
        for t in thumbnails(files):
            p = b"".join(x.tobytes() for x in t)
            whole = np.concatenate(t)
            rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), whole.shape[1] * 8, whole.shape[0] * 8, thumbnail_hash(whole)))
        return pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "width", "height", "thumb_hash"])

    docs = table(spark, sf_dir, "documents")
    got = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), store_texts(spark, F.col("text")).alias("media"))
    got = got.withColumn("r", read_back("media"))
    return got.select(
        "doc_id", "n_bytes", "r.payload_bytes", "r.payload_sha256", "r.tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.concat_ws("x", "r.width", "r.height"), "r.thumb_hash").alias("feature"), "r.width", "r.height",
    )
