"""Chat formatting in a prefix tree.

Conversations that share initial turns share nodes: a node is one turn after one sequence of turns
before it. Conversations are sorted by their turns' hashes, which is the tree's depth-first order,
and range-partitioned on that whole order, so that a first turn in a third of all conversations is
spread over many tasks; a partition is cut into packs of bounded size. In a pack the characters of a
node are emitted once, depth-first. A node has its position ids (those of its characters in the
conversation, counting from 0 along its ancestors) and its attention: the intervals of the pack that
its ancestors take, and its own, causally. Conversations that end at a node are listed there.

Template: a turn is `<s>[INST] role \n text [/INST]</s>` without the blanks, the text of an
assistant is under the loss mask. A control string inside a role or text gets a backslash after its
first character (one more if it has some already), a newline in a role is `[n]` guarded likewise,
so texts come back exactly.

Defined results: null texts are empty, a null role is an empty one; rows are ordered by turn, then by
role and text where turns tie; null turns come first; rows without conv_id are one conversation;
repeated rows are turns of their own; extra columns are ignored; an empty table has no packs."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

OPEN, CLOSE = "<s>[INST]", "[/INST]</s>"
_CONTROL = r"(?:(?<=<)\\*(?=/?s>)|(?<=\[)\\*(?=/?INST\]|n\]))"
_ADD = re.compile(_CONTROL)
_CUT = re.compile(r"(?:(?<=<)\\(\\*)(?=/?s>)|(?<=\[)\\(\\*)(?=/?INST\]|n\]))")
_TURN = re.compile(re.escape(OPEN) + r"(.*)\n((?s:.*))" + re.escape(CLOSE))
PACK_CHARS = 65_536  # a pack is closed when it has so many characters
LONG = 4096  # turns kept in one sort key


def escape(text: str) -> str:
    return _ADD.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _CUT.sub(lambda m: m[1] or m[2] or "", text)


def turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text begins and ends in it."""
    head = OPEN + escape(role).replace("\n", "[n]") + "\n"
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def read_turn(s: str) -> tuple[str, str]:
    m = _TURN.fullmatch(s)
    if not m:
        raise ValueError("not a formatted turn")
    # a newline of the role stands unguarded, one that the role spelt out is guarded
    return unescape(re.sub(r"\[n\]", "\n", m[1])), unescape(m[2])


NODE = "struct<start: long, position: long, text: string, loss_begin: int, loss_end: int, attend: array<struct<begin: long, end: long>>, ends: array<long>, none_ends: int>"
PACK = f"nodes array<{NODE}>"


def _pack(rows: list[tuple[int | None, list[tuple[str, str]]]]) -> list[dict]:
    """The nodes of a pack, depth-first; rows are sorted so that shared turns are neighbours."""
    nodes: list[dict] = []
    path: list[tuple[tuple[str, str], dict]] = []
    at = 0
    for conv, turns in rows:
        k = 0
        while k < len(path) and k < len(turns) and path[k][0] == turns[k]:
            k += 1
        del path[k:]
        for t in turns[k:]:
            s, a, b = turn(*t)
            up = path[-1][1] if path else None
            attend = []
            if up:
                attend = [*up["attend"], {"begin": up["start"], "end": up["start"] + len(up["text"])}]
                if len(attend) > 1 and attend[-2]["end"] == attend[-1]["begin"]:
                    attend[-2:] = [{"begin": attend[-2]["begin"], "end": attend[-1]["end"]}]
            mask = (a, b) if t[0] == "assistant" else (0, 0)
            node = {"start": at, "position": up["position"] + len(up["text"]) if up else 0, "text": s, "loss_begin": mask[0], "loss_end": mask[1], "attend": attend, "ends": [], "none_ends": 0}
            at += len(s)
            nodes.append(node)
            path.append((t, node))
        if conv is None:
            path[-1][1]["none_ends"] += 1
        else:
            path[-1][1]["ends"].append(conv)
    return nodes


def _packs(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows, held = [], 0
    for b in it:
        out = []
        for conv, turns in zip(b["conv_id"], b["turns"], strict=True):
            t = [(x["role"], x["text"]) for x in turns]
            rows.append((None if pd.isna(conv) else int(conv), t))
            held += sum(len(x) for _, x in t) + 32 * len(t)
            if held >= PACK_CHARS:
                out.append(_pack(rows))
                rows, held = [], 0
        if out:
            yield pd.DataFrame({"nodes": out})
    if rows:
        yield pd.DataFrame({"nodes": [_pack(rows)]})


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> packs(nodes)."""
    spark = conversations.sparkSession
    small_batches(spark, 1024)
    clean = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    key = F.transform(F.slice("turns", 1, LONG), lambda t: F.xxhash64(t["role"], t["text"]))
    convs = convs.select("conv_id", key.alias("key"), F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    convs = convs.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").select("conv_id", "turns")
    return convs.mapInPandas(_packs, PACK)


def read_back(nodes: list[dict]) -> Iterator[tuple[int | None, list[tuple[str, str, str | None]], int]]:
    """Conversations of a pack, from its characters, position ids and attention alone: id, turns as
    (role, text, text under the loss mask), formatted characters."""
    flat = "".join(n["text"] for n in nodes)
    bounds = {n["start"]: n for n in nodes}
    for n in nodes:
        who = [*n["ends"], *[None] * n["none_ends"]]
        if not len(who):
            continue
        chain, at = [], 0
        for span in [*n["attend"], {"begin": n["start"], "end": n["start"] + len(n["text"])}]:
            i = span["begin"]
            while i < span["end"]:
                m = bounds[i]
                if m["position"] != at:
                    raise ValueError("position ids don't follow the ancestors")
                s = flat[i : i + len(m["text"])]
                loss = unescape(s[m["loss_begin"] : m["loss_end"]]) if m["loss_end"] else None
                chain.append((*read_turn(s), loss))
                at += len(s)
                i += len(s)
        for w in who:
            yield w, chain, at


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    packs = format_conversations(convs.unionByName(extra))

    def digest(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            rows = []
            for nodes in b["nodes"]:
                for conv, turns, size in read_back(list(nodes)):
                    whole = "".join(f"{r}\n{t}\n" for r, t, _ in turns).encode("utf-8", "surrogatepass")
                    loss = "".join(x for _, _, x in turns if x is not None)
                    rows.append((conv, len(turns), hashlib.sha256(whole).hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), size))
            out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            yield out.astype({"conv_id": "Int64", "n_turns": np.int64, "loss_chars": np.int64, "formatted_chars": np.int64})

    return packs.mapInPandas(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(regexp_replace(text, '<(\\*)(/?s>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\]|n\])', '[\\\1\2', 'g') AS esc FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(esc) + 21)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
