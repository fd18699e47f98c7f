"""Bounded, balanced training windows from labelled texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytecnn import ByteCNN


def train(rows: DataFrame, label: str, max_texts: int, epochs: int, windows: int = 4, seed: int = 7, filters: int = 8) -> ByteCNN | None:
    """Fit a ByteCNN on rows(text, label, doc_id) without null labels.

    max_texts bounds the sample: each label gets an equal share, chosen by a hash of the id,
    and each text gives at most `windows` windows, spread evenly over it. None without rows."""
    rows = rows.where(F.col(label).isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not counts:
        return None
    classes = sorted(counts)
    share = max_texts // len(classes)
    keep = F.lit(False)
    for c in classes:
        keep |= (F.col(label) == F.lit(c)) & (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * min(1, share / counts[c]) + 1))
    n, size = F.length("text"), ByteCNN(classes).window
    cuts = F.array(*[F.substring("text", (n * j / windows).cast("int") + 1, F.lit(size)) for j in range(windows)])
    got = rows.where(keep).select(F.col(label).alias("y"), F.array_distinct(cuts).alias("x"), F.xxhash64("doc_id", "text").alias("o")).limit(2 * max_texts).collect()
    got.sort(key=lambda r: (r.o, r.x))
    model = ByteCNN(classes, filters=filters, seed=seed)
    data = [(t.encode("utf-8", "surrogatepass")[:size], classes.index(r.y)) for r in got for t in r.x if t]
    if len(classes) > 1:
        x, _, _ = model.cut([t for t, _ in data])
        model.fit(x, np.array([y for _, y in data]), epochs)
    return model
