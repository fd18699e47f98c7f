"""Edge cases and brute-force comparisons of the text operators, all on one small table with nulls, empty and
long texts, ties, repeated rows and columns with clashing names."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from larkdoc.llm import bytecnn, chat, common, components, decontaminate, jpeg, langid, licenses, lines, pieces, quality, simhash, substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["alpha", "beta", "Gamma", "d", "épée", "漢字", "x1", "THE", "of"]


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 999)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(8)
    passage, line = prose(rnd, 40), prose(rnd, 20)
    out = [(i, prose(rnd, rnd.randint(1, 60)) + rnd.choice(["", "\n" + line, "\n" + passage, " " + passage]) + "\n" + prose(rnd, 12)) for i in range(60)]
    out += [(100, None), (101, ""), (102, "   \n\t "), (103, "12345 !!"), (104, out[3][1]), (105, out[3][1] + " end"), (106, prose(rnd, 8000)), (107, line.replace("0", "9", 1)), (108, "a" * 70000)]
    return [(i, t, rnd.choice(["en", "de", None]), "s", None) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([*rows, rows[5], (None, "no id here", None, None, None)], SCHEMA).repartition(3)


@pytest.fixture()
def tables(docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def texts_of(rows):
    return [(r[0], r[1]) for r in rows]


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 50)] + [(rnd.randint(200, 260), rnd.randint(200, 260)) for _ in range(30)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: top(x) for e in edges for x in e if e[0] != e[1] or x in got}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_line_dedup(spark, rows, docs):
    got = {r.doc_id: r for r in lines.dedup_lines(docs.withColumn("line", F.lit(1)).withColumn("pos", F.lit(2))).collect()}
    want = lines.brute_force([(-1, "no id here"), *texts_of(rows)])
    assert len(got) == len(rows) + 1
    for d, t in texts_of(rows):
        assert (got[d]._lines.n_removed or 0, got[d]._lines.text) == want[d][1:], d
    assert lines.dedup_lines(docs.limit(0)).count() == 0
    assert lines.drop_repeated_lines(docs).columns == docs.columns


def test_line_dedup_hot_template(spark, monkeypatch):
    """One template, many clusters of near copies: no two clusters reach 0.8, and the buckets hold far more lines than centres."""
    monkeypatch.setattr(lines, "CHUNK", 50, raising=False)  # several chunks a bucket
    rnd = random.Random(5)
    core, rows = prose(rnd, 22), []
    for i in range(120):
        fill = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(24))
        rows += [(3 * i + k, f"{core} {fill}{x}") for k, x in enumerate(("", " 1", " 2"))]
    want = lines.brute_force(rows)
    assert sum(n for _, n, _ in want.values()) == 240
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r._lines.n_lines, r._lines.n_removed or 0, r._lines.text) for r in got.collect()} == want


def test_line_dedup_crowd(spark):
    """One 40-word line, 600 times with two words changed: one crowd in which most pairs are near 0.8."""
    rnd = random.Random(600)
    base, rows = [rnd.choice(WORDS) + str(rnd.randint(0, 999)) for _ in range(40)], []
    for i in range(600):
        w = list(base)
        for k in rnd.sample(range(40), 2):
            w[k] = rnd.choice(WORDS) + str(rnd.randint(0, 999))
        rows.append((i, " ".join(w)))
    want = lines.brute_force(rows)
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    removed, all_removed = ({r[0] for r in x if r[1]} for x in ([(r.doc_id, r._lines.n_removed) for r in got.collect()], [(d, n) for d, (_, n, _) in want.items()]))
    assert removed == all_removed


def test_line_dedup_clashing_names(spark):
    """Extra columns keep their values whatever they are called, also those the operator uses itself."""
    names = ["row", "stay", "id", "doc", "rid", "split", "left", "_lines", "_doc", "_rid", "k1", "a"]
    docs = spark.createDataFrame([(1, "one\none", *range(len(names))), (2, "one", *range(len(names)))], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    got = {r.doc_id: r for r in lines.drop_repeated_lines(docs).collect()}
    assert {d: r.text for d, r in got.items()} == {1: "one", 2: ""}
    assert all(tuple(r)[2:] == tuple(range(len(names))) for r in got.values())
    ints = spark.createDataFrame([(1, "x"), (2, "x")], "doc_id int, text string")
    assert lines.drop_repeated_lines(ints).schema == ints.schema


def test_line_dedup_short_lines(spark):
    """Bands of short lines are independent enough: four shingles of five are found as often as in long lines."""
    rnd = random.Random(11)
    short = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(1000)]
    docs = spark.createDataFrame([(i, f"{x}\n{x[:8]}") for i, x in enumerate(short)], "doc_id long, text string")
    found = {}
    bands = F.array(*[f"b{b}" for b in range(lines.BANDS)])
    for r in lines.signatures(docs).select(*lines.unpacked_place(F.col("place")), bands).collect():
        found.setdefault(r[0], []).append(set(r[3]))
    assert sum(len(b) == 2 and not b[0].isdisjoint(b[1]) for b in found.values()) >= 980


def test_line_dedup_one_character(spark):
    """Ordinary lines of 12 words that differ in one character reach 0.8 and are one line."""
    rnd = random.Random(3)
    rows = []
    for i in range(40):
        line = prose(rnd, 12)
        at = len(line) // 2
        other = line[:at] + ("#" if line[at] != "#" else "$") + line[at + 1 :]
        rows += [(2 * i, line), (2 * i + 1, other)]
    rows += [(100, "abc"), (101, "abd"), (102, "héé\U0001f600x"), (103, "héé\U0001f600y"), (104, "x" * 400 + "end"), (105, "x" * 500 + "end")]
    want = lines.brute_force(rows)
    assert sum(n for _, n, _ in want.values()) >= 40
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r._lines.n_lines, r._lines.n_removed or 0, r._lines.text) for r in got.collect()} == want


def test_license_scan(spark, rows, docs):
    rnd = random.Random(2)
    cut = [" ".join(t.split()[rnd.randint(0, 2) :]) for t in licenses.TEMPLATES.values()]
    texts = [None, "", "one two", *cut, *(prose(rnd, 30) + " " + t + " " + prose(rnd, 9) for t in cut), cut[1] + " x " + cut[1]]
    assert licenses.Templates(licenses.TEMPLATES).scan(texts) == licenses.brute_force(texts)
    got = docs.withColumn("license", licenses.scan_column(spark, F.concat(F.coalesce("text", F.lit("")), F.lit(" Released under the MIT License."))))
    assert all([x.license for x in r.license] == ["MIT"] for r in got.collect())


def test_media(spark, docs, tables):
    got = {r.doc_id: r for r in jpeg.op3_media_columns(spark, tables).collect()}
    for d, t in {(r.doc_id, r.text) for r in docs.collect()}:
        raw = (t or "").encode()
        p = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (got[d].n_bytes, got[d].payload_bytes, got[d].payload_sha256, got[d].tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    bad = spark.createDataFrame([(1, None), (2, b""), (3, b"\xff\xd8 no"), (4, jpeg.encode([b"ab" * 96])[0]), (5, jpeg.encode([b"ab" * 96])[0][:-30])], "id int, m binary")
    assert [r.c.width for r in bad.select("id", jpeg.media_columns(spark, F.col("m")).alias("c")).orderBy("id").collect()] == [None, None, None, 1536, None]


def test_jpeg_of_several_images_and_all_bytes():
    p = [bytes(range(256)) * 3, np.random.default_rng(1).integers(0, 256, 192 * 8200, np.uint8).tobytes()]
    back = jpeg.thumbnails(jpeg.encode(p))
    assert [b"".join(x.tobytes() for x in t) for t in back] == p and len(back[1]) == 2


def test_language_and_quality(spark, rows, docs, tables):
    got = {r.doc_id: r for r in langid.op4_language_id(spark, tables).collect()}
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d in (100, 101, 102, 103)) and got[1].lang_pred in ("de", "en")
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d in range(60))
    assert langid.fit(docs.limit(0)) is None and langid.keep_identified(spark, docs).columns == docs.columns
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    scores = [r.s for r in docs.select(quality.score(spark, model, F.col("text")).alias("s")).collect()]
    assert len(scores) == len(rows) + 2 and all(0 <= s <= 1 for s in scores)
    assert quality.fit(docs, labels.limit(0)) is None


def test_network_windows_cover_the_text_and_it_learns():
    m = bytecnn.ByteCNN([0, 1])
    raw = bytes(random.Random(3).choices(range(1, 256), k=3000))
    x, owner, size = m.cut([raw, b"", b"ab"])
    assert b"".join(bytes(w[: m.stride]) for w in x[owner == 0]).rstrip(b"\0").startswith(raw[: m.stride]) and list(size[owner > 0]) == [0, 2]
    assert bytes(x[owner == 0][-1][: size[owner == 0][-1]]) == raw[-size[owner == 0][-1] :]
    rnd = random.Random(4)
    texts = [(("!! " if i % 2 else "ab ") + prose(rnd, 5)).encode() for i in range(400)]
    x, owner, _ = m.cut(texts[:300])
    m.fit(x, np.array([i % 2 for i in owner]), 60)
    assert (m.texts(texts[300:]).argmax(1) == np.arange(300, 400) % 2).mean() > 0.9


def reference_fingerprint(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("chunk", [2048, 3])
def test_simhash(spark, rows, docs, tables, chunk, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    got = {r.doc_id: r for r in simhash.op5_simhash_near_dedup(spark, tables).collect()}
    fp = {d: reference_fingerprint(t) for d, t in texts_of(rows)}
    assert all(int(got[d].fingerprint, 16) == fp[d] for d in fp)
    low = {d: d for d in fp}
    for _ in fp:
        for a in fp:
            for b in fp:
                if (fp[a] ^ fp[b]).bit_count() <= 4:
                    low[a] = min(low[a], low[b])
    assert all(got[d].component_id == low[d] for d in fp)
    kept = [r.doc_id for r in simhash.drop_near_duplicates(spark, docs).collect()]
    assert sorted(x for x in kept if x is not None) == sorted({*low.values()}) and kept.count(None) == 1


def test_simhash_crowded_keys(spark, monkeypatch):
    """Every block of bits has few values, so every first bucket is crowded and dealt again, up to the chunks."""
    monkeypatch.setattr(simhash, "CHUNK", 24)
    rnd = random.Random(12)
    blocks = [[rnd.getrandbits(13) for _ in range(3)] for _ in range(5)]
    fp = set()
    while len(fp) < 500:
        x = sum(rnd.choice(b) << (k * 64 // 5) for k, b in enumerate(blocks)) & (2**64 - 1)
        for _ in range(rnd.choice([0, 1, 2, 4, 9])):
            x ^= 1 << rnd.randrange(64)
        fp.add(x)
    sign = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    fps = spark.createDataFrame([(i, sign(x)) for i, x in enumerate(sorted(fp))], "doc_id long, fp long").repartition(3)
    got = {r.fp: r.component_id for r in simhash.classes(fps).collect()}
    order = sorted(fp)
    low = list(range(len(order)))
    links = [(i, j) for i in range(len(order)) for j in range(i) if (order[i] ^ order[j]).bit_count() <= 4]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            m = min(low[i], low[j])
            changed |= low[i] != m or low[j] != m
            low[i] = low[j] = m
    assert links and got == {sign(x): low[i] for i, x in enumerate(order)}


def test_simhash_one_row_of_an_id(spark):
    docs = spark.createDataFrame([(1, "b", 1, 1), (1, "a", 2, 2), (1, "a", 2, 2), (2, "c d e f g", 3, 3)], "doc_id long, text string, n int, row int")
    assert sorted((r.doc_id, r.text, r.n, r.row) for r in simhash.drop_near_duplicates(spark, docs).collect()) == [(1, "a", 2, 2), (2, "c d e f g", 3, 3)]
    assert simhash.drop_near_duplicates(spark, docs.limit(0)).count() == 0


def test_dense_buckets_keep_every_link():
    rnd = np.random.default_rng(5)
    fp = np.unique(rnd.integers(0, 2**64, 1, np.uint64) ^ (np.uint64(1) << rnd.integers(20, 60, (300, 3), np.uint64)).sum(1, dtype=np.uint64))
    u, v = simhash.bucket_links(np.zeros(len(fp), np.int64), fp, np.zeros(len(fp), np.int8), simhash.table_of(fp))
    up = {int(x): int(x) for x in fp.view(np.int64)}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        up[top(a)] = top(b)
    links = [(int(a), int(b)) for i, a in enumerate(fp) for b in fp[:i] if (int(a) ^ int(b)).bit_count() <= 4]
    sign = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    assert all(top(sign(a)) == top(sign(b)) for a, b in links)


@pytest.mark.parametrize("block", [200_000, 30])
def test_decontamination(spark, rows, docs, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    rnd = random.Random(6)
    items = [(1, " ".join(rows[2][1].split()[:14])), (2, rows[9][1].upper() if rows[9][1].isascii() else rows[9][1]), (10, "x1"), (11, None), (12, " !! "), (None, prose(rnd, 11)), (1, prose(rnd, 4)), (13, rows[66][1][:300])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r._scan for r in decontaminate.scan(spark, docs.withColumn("hit", F.lit(1)), bench).collect()}
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    for d, t in texts_of(rows):
        w, hit, who = norm(t), set(), set()
        for i, x in items:
            x = norm(x)
            for k in range(max(1, len(x) - 9)) if x else ():
                g = x[k : k + 10]
                for p in range(len(w) - len(g) + 1):
                    if w[p : p + len(g)] == g:
                        hit |= set(range(p, p + len(g)))
                        who |= {str(i)} if i is not None else set()
        assert (got[d].n_words, got[d].n_hit, got[d].n_items, got[d].items_sha256) == (len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest()), d
        assert sum(len(norm(t.encode()[s.begin : s.end].decode())) for s in got[d].spans) == len(hit)
    assert decontaminate.drop_contaminated(spark, docs, bench.limit(0)).count() == docs.count()


@pytest.mark.parametrize("hot", [2000, 2])
def test_substrings(spark, rows, docs, tables, hot, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", hot)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.op7_substring_dedup(spark, tables).collect()}
    want = substrings.brute_force(texts_of(rows))
    assert {d: got[d] for d in want} == want and got[None][1] == 0 and sum(x[1] for x in want.values()) > 300
    assert substrings.remove_duplicates(docs.withColumn("begin_", F.lit(1)).limit(0)).count() == 0


def test_pieces(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = docs.select("text", pieces.encode_column(spark, F.col("text")).alias("ids"))
    for r in got.withColumn("back", pieces.decode_column(spark, F.col("ids"))).collect():
        assert r.ids == (sp.encode(r.text) if r.text is not None else None) and r.back == r.text
    with open(pieces.MODEL, "rb") as f:
        p, rnd = pieces.Pieces(f.read()), random.Random(7)
    texts = ["".join(rnd.choices(" abcdeth\n\t\x00▁é漢😀<>/sion", k=rnd.randint(0, 50))) for _ in range(500)]
    assert [x.tolist() for x in p.encode(texts)] == sp.encode(texts)


def test_chat(spark, tmp_path):
    rnd = random.Random(9)
    odd = ["</s>", "[INST]", "<\\s>", "[/INST]", "<s>[INST]", "", None, "a\nb", "[n]", "\\", "hello"]
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None, "a\n[n]"]) if c % 3 else ["user", "assistant"][t % 2], rnd.choice(odd) if c % 3 else "same") for c in range(40) for t in range(rnd.randint(1, 6))]
    rows += [(None, 0, "user", "x"), (5, None, "user", "null turn"), rows[0]]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op9_chat_format(spark, str(tmp_path)).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=key)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(mine), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()), c
    assert got[-7].loss_chars == 21
    packs = chat.format_conversations(spark.createDataFrame([(i, t, "user", "shared" if t < 2 else str(i)) for i in range(9) for t in range(3)], "conv_id long, turn long, role string, text string").coalesce(1))
    assert sum(n.text.count("shared") for p in packs.collect() for n in p.nodes) < 18
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_pipeline(spark, tables):
    import corpus_pipeline

    spark.createDataFrame([(1, "no such words at all in any of these texts here")], "item_id long, text string").write.parquet(f"{tables}/benchmark.parquet")
    got = corpus_pipeline.run(spark, tables)
    rows = got.collect()
    assert rows and all(r.n_tokens == len(r.ids) for r in rows) and not {100, 101, 102, 103} & {r.doc_id for r in rows}
    assert all(r.n_tokens == 0 for r in rows if r.doc_id == 104)  # its lines stand in another document


def test_clashing_names_pass_through(spark):
    """Columns named like those the operators use themselves keep their values."""
    names = ["_p", "_scan", "begin", "end", "d", "r", "rid", "_d", "_r", "lang_pred"]
    docs = spark.createDataFrame([(i, prose(random.Random(i // 2), 30), "en", "s", 1, *range(len(names))) for i in range(6)], SCHEMA + "".join(f", `{n}` int" for n in names))
    bench = spark.createDataFrame([(1, prose(random.Random(0), 30))], "item_id long, text string")
    kept = langid.keep_identified(spark, docs, 0.0)
    clean = decontaminate.drop_contaminated(spark, docs, bench)
    deduped = substrings.remove_duplicates(docs)
    assert kept.columns == clean.columns == docs.columns and deduped.columns == [*docs.columns, "_kept"]
    assert sorted(r.doc_id for r in clean.collect()) == [2, 3, 4, 5] and kept.count() == 6
    assert {r.doc_id: r._kept.n_removed for r in deduped.collect()} == {0: 0, 1: 30, 2: 0, 3: 30, 4: 0, 5: 30}
    for df in (kept, clean, deduped):
        assert all([r[n] for n in names] == list(range(len(names))) for r in df.collect())


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    from larkdoc.llm import queries

    for name in ("op2_license_scan", "op3_media_columns", "op4_language_id", "op5_simhash_near_dedup", "op6_decontaminate", "op8_sentencepiece", "op10_quality"):
        assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0, name


def test_letters(spark):
    """Digits and signs that count as word characters are no letters."""
    learn = spark.createDataFrame([(i, ("ab cd " if i % 2 else "xyz uvw ") * 20, "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string")
    docs = spark.createDataFrame([(1, "\u00b2 \u00bd \u2167 \u2460"), (2, "1 abc"), (3, "\u6f22"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.p.lang for r in docs.select("doc_id", langid.predict(spark, langid.fit(learn, epochs=1), F.col("text")).alias("p")).collect()}
    assert got[1] == got[4] == "und" and {got[2], got[3]} <= {"en", "de"}


def test_line_dedup_cells():
    """A cell's links span what brute force joins, over any sides, components and characters, and never join lines under 0.8."""
    rnd = random.Random(4)
    for _ in range(300):
        n, letters = rnd.randint(2, 14), rnd.choice(["ab", "abcdefgh\0", "aé漢字\U0001f600\0"])
        base = [rnd.choice(letters) for _ in range(rnd.randint(1, 60))]
        texts = []
        for _ in range(n):
            w = list(base)
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = rnd.choice(letters)
            texts.append("".join(w)[: rnd.randint(max(1, len(w) - 4), len(w))])
        sides = [rnd.choice((1, 2)) for _ in texts] if rnd.random() < 0.5 else [0] * n
        comps = [rnd.randint(0, n) for _ in texts]
        sets = [{x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in texts]
        links = [(i, j) for i in range(n) for j in range(i) if (sides[i] != sides[j] or not sides[i]) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]

        def joined(pairs, n=n, comps=comps):
            lab = list(comps)
            for u, v in pairs:
                lab = [lab[u] if x == lab[v] else x for x in lab]
            return {frozenset(j for j in range(n) if lab[j] == lab[i]) for i in range(n)}

        got = lines.cell_links(list(range(n)), sides, comps, texts)
        assert {(max(p), min(p)) for p in got} <= set(links)
        assert joined(got) == joined(links)


def test_network_equals_naive_convolution():
    """The windows' logits against a convolution written out position by position."""
    rnd = np.random.default_rng(3)
    model = bytecnn.ByteCNN(["a", "b", "c"], window=24, filters=2, dim=3, seed=5)
    model.p["b"] = rnd.normal(0, 1, len(model.p["b"])).astype(np.float32)
    x = rnd.integers(0, 256, (5, 24), dtype=np.uint8)
    wide = max(model.widths)
    kernel = model.p["k"].reshape(wide, model.dim, -1)
    for row, got in zip(x, model.logits(x, block=2), strict=True):
        pooled = []
        for f in range(kernel.shape[2]):
            width = model.widths[f // model.filters]
            assert not kernel[width:, :, f].any()  # a filter sees its own width only
            at = [sum(float(model.p["e"][row[i + k], d] * kernel[k, d, f]) for k in range(width) for d in range(model.dim)) for i in range(len(row) - wide + 1)]
            pooled.append(max(0.0, max(at) + float(model.p["b"][f])))
        assert np.allclose(got, np.array(pooled) @ model.p["w"] + model.p["c"], atol=1e-4)


def test_held_out_accuracy(spark):
    """Languages and quality of documents that no training has seen, on a table of the shared test data."""
    sf = "/root/testdata/sf0.01"
    if not os.path.exists(f"{sf}/documents.parquet"):
        pytest.skip("no test data here")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    lang = langid.op4_language_id(spark, sf).where("held_out").join(docs.where("lang is not null").select("doc_id", "lang"), "doc_id")
    right, n = lang.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 50 and right >= 0.95 * n, (right, n)
    good = quality.op10_quality(spark, sf).where("held_out").join(labels.where("quality is not null").select("doc_id", "quality"), "doc_id")
    right, n = good.agg(F.sum((F.col("quality") == F.col("predicted")).cast("int")), F.count("*")).first()
    assert n > 50 and right >= 0.85 * n, (right, n)


def test_line_dedup_shuffle(spark):
    """The bands are shuffled once, by key and line alone: their rows are most of what op1 keeps on disk."""
    docs = spark.createDataFrame([(i, f"line {i} of the table\nsome more {i}") for i in range(50)], "doc_id long, text string")
    got = lines.buckets_of(lines.staged(lines.signatures(docs)))
    got.collect()
    final = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in final


def test_staged_shuffle_files(spark):
    """A staged table leaves no shuffle files behind, and the session's setting is as before."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, blocks = spark.conf.get(key), spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = blocks.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    there = shuffled()
    got = common.staged(spark.range(100000).select("id", F.xxhash64("id").alias("h")).repartition(4, "h").groupBy("h").agg(F.min("id")))
    assert got.count() == 100000
    assert not [x for x in shuffled() - there if x.endswith(".data") and blocks.getFile(x).length() > 10000]
    assert spark.conf.get(key) == before


def test_line_dedup_without_python(spark, monkeypatch):
    """Line dedup is DataFrame functions alone, and finds lines of few shingles whatever their lengths."""
    rows = [(1, "ab " * 20 + "x"), (2, "ab " * 200 + "x"), (3, "quite another line, of ordinary words that stand here once\nshort"), (4, "quite another line, of ordinary words that stand here twice"), (5, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(docs), name, lambda *a, **b: pytest.fail("Python on the executors"))
    want = lines.brute_force(rows)
    assert sum(n for _, n, _ in want.values()) == 3
    assert {r.doc_id: (r._lines.n_lines, r._lines.n_removed or 0, r._lines.text) for r in lines.dedup_lines(docs).collect()} == want
