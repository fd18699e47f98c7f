"""License scans: templates of public licence notices are retrieved by MinHash bands over
overlapping text windows and verified by exact containment of word shingles.

Words are lower-cased runs of letters, digits and bytes above 127; shingles are five words. For a
template of m distinct-position shingles, every run of m shingles of a text is a window (shorter at
the text's end), so windows overlap by all but one shingle. A band is one MinHash, an XOR permutation
of the shingles' hashes, and there are 16. A window that holds 80 % of a template's shingles has a
Jaccard similarity of at least 0.8 m / 1.2 m = 2/3 with it, so some band collides with probability
1 - (1/3)^16, over 0.9999999. Windows that collide are verified on their words: containment of 0.8 or
more is a match. Of overlapping matches of one template the best, then the first, is reported.

Defined results: null and empty texts and texts under five words match nothing; repeated rows get
equal results; extra columns pass through; texts of any length are scanned whole."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table
from .decontaminate import word_offsets, words
from .substrings import _mix, word_hashes

SHINGLE = 5
BANDS = 16
CONTAINMENT = 0.8
# Widely published notices, by their common names.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
_MASKS = np.random.default_rng(16).integers(0, 2**64, BANDS, np.uint64)
_NONE = np.uint64(2**64 - 1)


def _shingles(w: list[bytes]) -> list[bytes]:
    return [b" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)]


def _shingle_hashes(h: np.ndarray) -> np.ndarray:
    s = h[: len(h) - SHINGLE + 1].copy()
    for k in range(1, SHINGLE):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - SHINGLE + 1 + k]
    return _mix(s)


class Templates:
    def __init__(self, texts: dict[str, str]) -> None:
        self.all = []
        for name, text in sorted(texts.items()):
            w = words(text)
            if len(w) < SHINGLE:
                raise ValueError(f"template {name} has under {SHINGLE} words")
            s = _shingles(w)
            h = _shingle_hashes(word_hashes([b" ".join(w)])[0])
            self.all.append((name, set(s), len(s), [int((h ^ m).min()) for m in _MASKS]))
        self.longest = max(m for _, _, m, _ in self.all)

    def candidates(self, split: list[list[bytes]]) -> dict[int, dict[int, np.ndarray]]:
        """By text and template: the starts of windows that collide in some band."""
        h, count = word_hashes([b" ".join(w) for w in split])
        n = np.maximum(count - SHINGLE + 1, 0)
        if not n.sum():
            return {}
        first, gap = np.cumsum(count) - count, self.longest
        begin = np.cumsum(n + gap) - n - gap
        owner = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        at = begin[owner] + within
        s = np.full(int((n + gap).sum()), _NONE)
        s[at] = _shingle_hashes(h)[first[owner] + within]
        real = np.zeros(len(s), bool)
        real[at] = True
        hits = [np.zeros(len(s), bool) for _ in self.all]
        for p, mask in enumerate(_MASKS):
            low = [np.where(real, s ^ mask, _NONE)]
            while 1 << len(low) <= self.longest:
                half = 1 << (len(low) - 1)
                low.append(np.minimum(low[-1], np.concatenate([low[-1][half:], np.full(half, _NONE)])))
            for t, (_, _, m, mins) in enumerate(self.all):
                k = m.bit_length() - 1
                a, d = low[k], m - (1 << k)
                want = np.uint64(mins[p])
                here = a == want
                hits[t] |= here & (np.concatenate([a[d:], np.full(d, _NONE)]) >= want)
                if d:
                    hits[t] |= (np.concatenate([a[d:], np.full(d, _NONE)]) == want) & (a >= want)
        out: dict[int, dict[int, np.ndarray]] = {}
        for t, x in enumerate(hits):
            x = np.flatnonzero(x & real)
            if len(x):
                who = np.searchsorted(begin, x, "right") - 1
                for d in np.unique(who):
                    out.setdefault(int(d), {})[t] = x[who == d] - begin[d]
        return out

    def verify(self, w: list[bytes], t: int, starts) -> list[tuple[float, int, int]]:
        """Matches of template t at the given starts: (containment, first word, end word)."""
        _, want, m, _ = self.all[t]
        s, found = _shingles(w), []
        for i in starts:
            c = len(want.intersection(s[i : i + m])) / len(want)
            if c >= CONTAINMENT:
                inside = [j for j in range(i, min(i + m, len(s))) if s[j] in want]
                found.append((c, inside[0], inside[-1] + SHINGLE))
        out: list[tuple[float, int, int]] = []
        for c, a, b in sorted(set(found), key=lambda x: (-x[0], x[1], x[2])):
            if all(b <= y or a >= z for _, y, z in out):
                out.append((c, a, b))
        return sorted(out, key=lambda x: x[1])

    def scan(self, texts: list[str | None]) -> list[list[tuple[str, float, int, int]]]:
        """For each text its matches: (licence, containment, first word, end word)."""
        split = [words(t) for t in texts]
        got = self.candidates(split)
        return [[(self.all[t][0], *x) for t, starts in sorted(got.get(i, {}).items()) for x in self.verify(w, t, starts.tolist())] for i, w in enumerate(split)]


def scan_column(spark: SparkSession, text: Column, templates: dict[str, str] | None = None) -> Column:
    """array<struct<license, containment, begin, end>>; begin and end in bytes of the original text."""
    small_batches(spark)
    known = spark.sparkContext.broadcast(Templates(templates or TEMPLATES))

    @F.pandas_udf("array<struct<license: string, containment: double, begin: long, end: long>>")
    def scan(s: pd.Series) -> pd.Series:
        texts = [t if isinstance(t, str) else None for t in s]
        rows = []
        for t, found in zip(texts, known.value.scan(texts), strict=True):
            at = word_offsets(t) if found else None
            rows.append([{"license": n, "containment": c, "begin": int(at[a][0]), "end": int(at[b - 1][1])} for n, c, a, b in found])
        return pd.Series(rows, dtype=object)

    return scan(text)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = table(spark, sf_dir, "documents").select("doc_id", scan_column(spark, F.col("text")).alias("m"))
    return got.select(
        "doc_id", F.size("m").cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct("m.license")), ",").alias("licenses"),
        F.coalesce(F.array_max("m.containment"), F.lit(0.0)).alias("best"), F.array_join(F.transform("m", lambda x: F.concat_ws("-", x["begin"], x["end"])), ",").alias("spans"),
    )


def brute_force(texts: list[str | None], templates: dict[str, str] | None = None) -> list[list[tuple[str, float, int, int]]]:
    """Every window of every text; for tests."""
    known = Templates(templates or TEMPLATES)
    split = [words(t) for t in texts]
    return [[(known.all[t][0], *x) for t in range(len(known.all)) for x in known.verify(w, t, range(len(w) - SHINGLE + 1))] for w in split]
