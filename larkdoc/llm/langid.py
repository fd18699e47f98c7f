"""Language identification by a convolutional network over bytes.

Defined results: a null text, an empty text or one without a letter (a character of which
str.isalpha is true) is `und` with score 0; with no labelled rows every text is `und`. Repeated rows get equal
results, extra columns pass through whatever their names, an empty table gives an empty one, a text of any length is read whole in fixed-length windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytecnn import ByteCNN
from .common import crc_mod, fresh, small_batches, table
from .training import train

MAX_TEXTS = 2400  # labelled texts the network is fitted on, at most twice this many if ids repeat
EPOCHS = 4


def fit(docs: DataFrame, max_texts: int = MAX_TEXTS, epochs: int = EPOCHS) -> ByteCNN | None:
    """Learns from text and lang of rows whose crc32(doc_id) mod 3 is not 1."""
    return train(docs.where(crc_mod(F.col("doc_id"), 3) != 1).select("doc_id", "text", "lang"), "lang", max_texts, epochs)


def predict(spark: SparkSession, model: ByteCNN | None, text: Column) -> Column:
    """struct<lang: string, score: double> for a text column."""
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)  # some 10 kB, whatever the input

    @F.pandas_udf("lang string, score double")
    def language(s: pd.Series) -> pd.DataFrame:
        m = held.value
        out = pd.DataFrame({"lang": ["und"] * len(s), "score": [0.0] * len(s)})
        use = [i for i, t in enumerate(s) if isinstance(t, str) and any(map(str.isalpha, t))] if m else []
        if use:
            p = m.texts([s.iloc[i].encode("utf-8", "replace") for i in use])
            best = p.argmax(1)
            out.loc[use, "lang"] = [m.classes[k] for k in best]
            out.loc[use, "score"] = p[range(len(use)), best]
        return out

    return language(text)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = docs.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), predict(spark, fit(docs), F.col("text")).alias("p"))
    return got.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def keep_identified(spark: SparkSession, docs: DataFrame, min_score: float = 0.3) -> DataFrame:
    """Documents whose language is known; those without a letter or below min_score go."""
    p, = fresh(docs, "_p")
    got = docs.withColumn(p, predict(spark, fit(docs), F.col("text")))
    return got.where((F.col(f"{p}.lang") != "und") & (F.col(f"{p}.score") >= min_score)).select(*[F.col(f"`{c}`") for c in docs.columns])
