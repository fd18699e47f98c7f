"""The Parquet tables as collections, each with the columns that carry its insertion order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from larkdoc.operators.collection import Collection

POSITION = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",),
    "orders": ("o_orderkey",), "events": ("event_id",), "documents": ("doc_id",), "embeddings": ("vec_id",), "pages": ("page_id",),
    "benchmark": ("item_id",), "labels": ("doc_id",), "conversations": ("conv_id", "turn"),
    # no key of its own: every column in turn
    "lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"),
}


def collection(spark: SparkSession, sf_dir: str, name: str) -> Collection:
    return Collection(spark.read.parquet(f"{sf_dir}/{name}.parquet"), POSITION[name])


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder below the one the cluster names in spark.checkpoint.dir, which driver and executors share.

    Where none is named, a local master may use a folder of its own; a cluster may not."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        named = tempfile.mkdtemp(prefix="larkdoc-")
    return f"{named.rstrip('/')}/larkdoc/{label}-{uuid.uuid4().hex}"
