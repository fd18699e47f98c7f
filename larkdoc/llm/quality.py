"""Document quality by a convolutional network over bytes.

Overlapping chunks cover the whole text; filters are max-pooled in each chunk and the chunks'
log-odds, averaged by length, give one probability. Null and empty texts are scored as an empty
chunk; with no labels every score is 0.5. Repeated rows get equal scores, extra columns pass through."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytecnn import ByteCNN
from .common import crc_mod, small_batches, table
from .training import train

MAX_TEXTS = 4000  # labelled texts the network is fitted on, at most twice this many if ids repeat
EPOCHS = 8
FILTERS = 16  # of each width
THRESHOLD = 0.3


def fit(docs: DataFrame, labels: DataFrame, max_texts: int = MAX_TEXTS, epochs: int = EPOCHS) -> ByteCNN | None:
    """Learns from labels.quality of rows whose crc32(doc_id) mod 5 is not 0."""
    marked = labels.where((crc_mod(F.col("doc_id"), 5) != 0) & F.col("quality").isin(0, 1)).select("doc_id", "quality").distinct()
    rows = docs.where(crc_mod(F.col("doc_id"), 5) != 0).select("doc_id", "text").join(marked, "doc_id")
    return train(rows, "quality", max_texts, epochs, seed=11, filters=FILTERS)


def score(spark: SparkSession, model: ByteCNN | None, text: Column) -> Column:
    """Probability of label 1 for a text column."""
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)  # some 10 kB, whatever the input

    @F.pandas_udf("double")
    def quality(s: pd.Series) -> pd.Series:
        m = held.value
        if m is None or 1 not in m.classes:
            return pd.Series([0.5 if m is None else 0.0] * len(s))
        p = m.texts([t.encode("utf-8", "replace") if isinstance(t, str) else b"" for t in s])
        return pd.Series(p[:, m.classes.index(1)])

    return quality(text)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    got = docs.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), score(spark, model, F.col("text")).alias("score"))
    return got.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
