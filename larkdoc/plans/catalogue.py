"""The registered queries of the document engine, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkdoc.operators import documents as D
from larkdoc.operators import mutations as M
from larkdoc.operators.collection import Collection
from larkdoc.plans.filters import query
from larkdoc.plans.policy import Policy, workspace
from larkdoc.sources.tables import collection
from larkdoc.streaming import deltas

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, sql: str, run: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name], ORACLE_SQL[name] = run, sql


def find(name: str, table: str, sql: str, f: dict | None = None, **rest) -> None:
    add(name, sql, lambda s, d: collection(s, d, table).find(f, **rest))


# The flagship: a filter on two fields, an order with a tie-break, a window.
find("flagship", "events", "SELECT * FROM events WHERE event_type = 'purchase' AND value >= 50 ORDER BY value DESC, event_id LIMIT 20",
     {"event_type": "purchase", "value": {"$gte": 50}}, sort=[("value", -1)], limit=20)

WHERE = {  # name: (table, filter, SQL condition)
    "find_all": ("region", {}, "TRUE"),
    "filter_eq": ("events", {"event_type": "purchase"}, "event_type = 'purchase'"),
    "filter_eq_explicit": ("orders", {"o_orderstatus": {"$eq": "F"}}, "o_orderstatus = 'F'"),
    "filter_eq_kind_mismatch": ("orders", {"o_orderkey": "7"}, "FALSE"),
    "filter_eq_float_on_int": ("orders", {"o_custkey": 7.0}, "o_custkey = 7"),
    "filter_ne": ("events", {"event_type": {"$ne": "view"}}, "event_type <> 'view'"),
    "filter_ne_missing": ("nation", {"absent": {"$ne": 1}}, "TRUE"),
    "filter_gt": ("lineitem", {"l_quantity": {"$gt": 45}}, "l_quantity > 45"),
    "filter_gte": ("customer", {"c_acctbal": {"$gte": 5000.5}}, "c_acctbal >= 5000.5"),
    "filter_lt": ("orders", {"o_orderpriority": {"$lt": "3"}}, "o_orderpriority < '3'"),
    "filter_lte": ("part", {"p_size": {"$lte": 10}}, "p_size <= 10"),
    "filter_range": ("events", {"value": {"$gte": 20, "$lt": 40}}, "value >= 20 AND value < 40"),
    "filter_gt_cross_kind": ("events", {"event_type": {"$gt": 5}}, "event_type IS NOT NULL"),
    "filter_lt_cross_kind": ("events", {"event_type": {"$lt": 5}}, "event_type IS NULL"),
    "filter_int_vs_float_exact": ("events", {"event_id": {"$gt": 2.5, "$lte": 90.25}}, "event_id >= 3 AND event_id <= 90"),
    "filter_in": ("orders", {"o_orderpriority": {"$in": ["1-URGENT", "5-LOW"]}}, "o_orderpriority IN ('1-URGENT', '5-LOW')"),
    "filter_in_mixed_kinds": ("orders", {"o_custkey": {"$in": [1, 2.0, "3", None]}}, "o_custkey IN (1, 2) OR o_custkey IS NULL"),
    "filter_nin": ("orders", {"o_orderstatus": {"$nin": ["F", "O"]}}, "o_orderstatus NOT IN ('F', 'O')"),
    "filter_in_empty": ("nation", {"n_name": {"$in": []}}, "FALSE"),
    "filter_nin_empty": ("nation", {"n_name": {"$nin": []}}, "TRUE"),
    "filter_exists_column": ("customer", {"c_name": {"$exists": True}}, "TRUE"),
    "filter_exists_no_column": ("customer", {"c_name.first": {"$exists": False}}, "TRUE"),
    "filter_size": ("embeddings", {"embedding": {"$size": 64}}, "len(embedding) = 64"),
    "filter_type_column": ("supplier", {"s_acctbal": {"$type": ["float64", "null"]}, "s_name": {"$type": "string"}}, "TRUE"),
    "filter_elem_match_scalar": ("embeddings", {"embedding": {"$elemMatch": {"$gte": 0.2, "$lt": 0.21}}}, "len(list_filter(embedding, lambda x: x::DOUBLE >= 0.2::DOUBLE AND x::DOUBLE < 0.21::DOUBLE)) > 0"),
    "filter_and": ("orders", {"$and": [{"o_orderstatus": "O"}, {"o_totalprice": {"$gt": 100000}}]}, "o_orderstatus = 'O' AND o_totalprice > 100000"),
    "filter_or": ("orders", {"$or": [{"o_orderstatus": "P"}, {"o_totalprice": {"$lt": 5000}}]}, "o_orderstatus = 'P' OR o_totalprice < 5000"),
    "filter_not": ("orders", {"$not": {"o_orderstatus": "F"}}, "NOT (o_orderstatus = 'F')"),
    "filter_field_not": ("orders", {"o_totalprice": {"$not": {"$gt": 1000, "$lt": 200000}}}, "NOT (o_totalprice > 1000 AND o_totalprice < 200000)"),
    "filter_nested_logic": ("lineitem", {"$or": [{"$and": [{"l_returnflag": "R"}, {"l_quantity": {"$gte": 40}}]}, {"$not": {"$or": [{"l_linestatus": "O"}, {"l_discount": {"$lt": 0.09}}]}}]},
                            "(l_returnflag = 'R' AND l_quantity >= 40) OR NOT (l_linestatus = 'O' OR l_discount < 0.09)"),
}
for _name, (_table, _f, _sql) in WHERE.items():
    find(_name, _table, f"SELECT * FROM {_table} WHERE {_sql}", _f)

find("project_fields", "customer", "SELECT c_custkey, c_name, c_acctbal FROM customer", project=["c_custkey", "c_name", "c_acctbal", "absent"])
find("sort_single", "orders", "SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25", sort=[("o_totalprice", 1)], limit=25)
find("sort_desc", "customer", "SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25", sort=[("c_acctbal", -1)], limit=25)
find("sort_multi", "orders", "SELECT * FROM orders ORDER BY o_orderpriority, o_orderstatus DESC, o_orderdate DESC, o_orderkey LIMIT 40",
     sort=[("o_orderpriority", 1), ("o_orderstatus", -1), ("o_orderdate", -1)], limit=40)
find("skip_limit", "orders", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 30 OFFSET 50", skip=50, limit=30)
find("top_k", "lineitem", "SELECT * FROM lineitem WHERE l_returnflag = 'A' ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 15",
     {"l_returnflag": "A"}, sort=[("l_extendedprice", -1)], limit=15)
find("limit_zero", "nation", "SELECT * FROM nation LIMIT 0", limit=0)
find("skip_beyond", "nation", "SELECT * FROM nation LIMIT 0", skip=1000)
find("find_one", "events", "SELECT * FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 1", {"event_type": "error"}, limit=1)

add("seek_page_first", "SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20", lambda s, d: collection(s, d, "orders").page([("o_orderdate", 1)], 20))
add("seek_page_next", "SELECT * FROM orders WHERE o_orderpriority > '2-HIGH' OR (o_orderpriority = '2-HIGH' AND o_orderkey > 100) ORDER BY o_orderpriority, o_orderkey LIMIT 20",
    lambda s, d: collection(s, d, "orders").page([("o_orderpriority", 1)], 20, {"o_orderpriority": "2-HIGH", "o_orderkey": 100}))
add("seek_page_desc", "SELECT * FROM customer WHERE c_acctbal < 9000.0 OR (c_acctbal = 9000.0 AND c_custkey > 5) ORDER BY c_acctbal DESC, c_custkey LIMIT 20",
    lambda s, d: collection(s, d, "customer").page([("c_acctbal", -1)], 20, {"c_acctbal": 9000.0, "c_custkey": 5}))

add("count_filtered", "SELECT count(*) AS count FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_discount >= 0.05",
    lambda s, d: collection(s, d, "lineitem").count({"l_shipdate": {"$gte": datetime(1995, 1, 1)}, "l_discount": {"$gte": 0.05}}))
add("count_capped", "SELECT least(count(*), 100) AS count, count(*) >= 100 AS capped FROM lineitem WHERE l_returnflag = 'R'",
    lambda s, d: collection(s, d, "lineitem").count({"l_returnflag": "R"}, 100))
add("group_count", "SELECT event_type AS key, count(*) AS count FROM events WHERE value >= 10 GROUP BY 1",
    lambda s, d: collection(s, d, "events").group_count("event_type", {"value": {"$gte": 10}}))
add("group_count_missing", "SELECT NULL::VARCHAR AS key, count(*) AS count FROM orders", lambda s, d: collection(s, d, "orders").group_count("absent"))
add("group_count_first_rows", "SELECT o_orderstatus AS key, count(*) AS count FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 500) GROUP BY 1",
    lambda s, d: collection(s, d, "orders").group_count("o_orderstatus", most=500))


def _nulled(s: SparkSession, d: str) -> Collection:
    e = collection(s, d, "events")
    return Collection(e.df.withColumn("kind", F.when(F.col("event_type") != "view", F.col("event_type"))).select("event_id", "kind", "value"), e.position)


_NULLED = "(SELECT event_id, CASE WHEN event_type <> 'view' THEN event_type END AS kind, value FROM events)"
for _name, _f, _sql in (
    ("filter_null_eq", {"kind": None}, "kind IS NULL"), ("filter_null_ne", {"kind": {"$ne": "click"}}, "kind IS NULL OR kind <> 'click'"),
    ("filter_null_lt", {"kind": {"$lt": "d"}}, "kind IS NULL OR kind < 'd'"), ("filter_null_in", {"kind": {"$in": [None, "error"]}}, "kind IS NULL OR kind = 'error'"),
    ("filter_null_not", {"$not": {"kind": {"$gte": "e"}}}, "kind IS NULL OR NOT kind >= 'e'"), ("filter_type_null", {"kind": {"$type": "null"}}, "kind IS NULL"),
):
    add(_name, f"SELECT * FROM {_NULLED} WHERE {_sql}", lambda s, d, f=_f: _nulled(s, d).find(f))
add("group_count_null_key", f"SELECT kind AS key, count(*) AS count FROM {_NULLED} GROUP BY 1", lambda s, d: _nulled(s, d).group_count("kind"))
add("sort_nulls_first", f"SELECT * FROM {_NULLED} ORDER BY kind NULLS FIRST, event_id LIMIT 30", lambda s, d: _nulled(s, d).find(sort=[("kind", 1)], limit=30))
add("sort_nulls_last", f"SELECT * FROM {_NULLED} ORDER BY kind DESC NULLS LAST, event_id LIMIT 600", lambda s, d: _nulled(s, d).find(sort=[("kind", -1)], limit=600))


def _tagged(s: SparkSession, d: str) -> Collection:
    p = collection(s, d, "part")
    tags = F.filter(F.array(F.col("p_size") % 3, F.col("p_size") % 5, F.when(F.col("p_size") % 2 == 0, F.col("p_size") % 7)), lambda x: x.isNotNull())
    parts = F.array(F.struct((F.col("p_size") % 4).alias("kind"), F.col("p_size").alias("qty")), F.struct((F.col("p_size") % 3).alias("kind"), (F.col("p_size") * 2).alias("qty")))
    return Collection(p.df.select("p_partkey", tags.alias("tags"), parts.alias("parts"), F.struct(F.col("p_brand").alias("brand"), F.struct(F.col("p_size").alias("size")).alias("dim")).alias("info")), p.position)


_TAGGED = """(SELECT p_partkey, list_filter([p_size % 3, p_size % 5, CASE WHEN p_size % 2 = 0 THEN p_size % 7 END], lambda x: x IS NOT NULL) AS tags,
  [{'kind': p_size % 4, 'qty': p_size}, {'kind': p_size % 3, 'qty': p_size * 2}] AS parts, p_brand AS brand, p_size AS size FROM part)"""
for _name, _f, _sql in (
    ("filter_eq_array_member", {"tags": 2}, "list_contains(tags, 2)"), ("filter_eq_array_whole", {"tags": [1, 1]}, "tags = [1, 1]"),
    ("filter_in_array", {"tags": {"$in": [4, 6]}}, "list_contains(tags, 4) OR list_contains(tags, 6)"), ("filter_all", {"tags": {"$all": [1, 2, 1.0]}}, "list_contains(tags, 1) AND list_contains(tags, 2)"),
    ("filter_size_varied", {"tags": {"$size": 3}}, "len(tags) = 3"), ("filter_elem_match_object", {"parts": {"$elemMatch": {"kind": 1, "qty": {"$gte": 20}}}}, "len(list_filter(parts, lambda x: x.kind = 1 AND x.qty >= 20)) > 0"),
    ("filter_elem_match_not", {"tags": {"$elemMatch": {"$nin": [0, 1, 2], "$not": {"$gt": 4}}}}, "len(list_filter(tags, lambda x: x NOT IN (0, 1, 2) AND NOT x > 4)) > 0"),
    ("filter_dotted_path", {"info.dim.size": {"$gte": 30}, "info.brand": {"$gt": "Brand#2"}}, "size >= 30 AND brand > 'Brand#2'"), ("filter_range_on_array", {"tags": {"$gt": 1}}, "FALSE"),
):
    add(_name, f"SELECT p_partkey FROM {_TAGGED} WHERE {_sql}", lambda s, d, f=_f: _tagged(s, d).find(f, project=["p_partkey"]))

C = ["c_custkey"]
_cust = lambda s, d: collection(s, d, "customer").df
add("update_set", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer",
    lambda s, d: M.update_many(_cust(s, d), {"c_acctbal": {"$lt": 0}}, {"$set": {"c_mktsegment": "DEBT"}}, C))
add("update_unset", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_nationkey = 3 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer",
    lambda s, d: M.update_many(_cust(s, d), {"c_nationkey": 3}, {"$unset": {"c_mktsegment": True}}, C))
add("update_inc", "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 10.5 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer",
    lambda s, d: M.update_many(_cust(s, d), {"c_mktsegment": "BUILDING"}, {"$inc": {"c_acctbal": 10.5}}, C))
add("update_push", f"SELECT p_partkey, array_to_string(CASE WHEN list_contains(tags, 2) THEN list_append(tags, 9) ELSE tags END, ',') AS tags FROM {_TAGGED}",
    lambda s, d: M.update_many(_tagged(s, d).df, {"tags": 2}, {"$push": {"tags": 9}}, ["p_partkey"]).select("p_partkey", F.array_join("tags", ",").alias("tags")))
add("update_pull", f"SELECT p_partkey, array_to_string(list_filter(tags, lambda x: x <> 1), ',') AS tags FROM {_TAGGED}",
    lambda s, d: M.update_many(_tagged(s, d).df, {}, {"$pull": {"tags": 1.0}}, ["p_partkey"]).select("p_partkey", F.array_join("tags", ",").alias("tags")))
add("update_nested", f"SELECT p_partkey, CASE WHEN size > 25 THEN 0 ELSE size END AS size, brand FROM {_TAGGED}",
    lambda s, d: M.update_many(_tagged(s, d).df, {"info.dim.size": {"$gt": 25}}, {"$set": {"info.dim.size": 0}}, ["p_partkey"]).select("p_partkey", F.col("info.dim.size").alias("size"), F.col("info.brand").alias("brand")))
add("update_one", "SELECT n_nationkey, CASE WHEN n_nationkey = (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 2) THEN 'FIRST' ELSE n_name END AS n_name, n_regionkey FROM nation",
    lambda s, d: M.update_one(collection(s, d, "nation").df, {"n_regionkey": 2}, {"$set": {"n_name": "FIRST"}}, ["n_nationkey"]))
add("update_counts", "SELECT count(*) AS matched, count(*) FILTER (c_mktsegment <> 'BUILDING') AS modified FROM customer WHERE c_acctbal > 0",
    lambda s, d: M.updated(_cust(s, d), {"c_acctbal": {"$gt": 0}}, {"$set": {"c_mktsegment": "BUILDING"}}, C).where("_matched").agg(F.count("*").alias("matched"), F.count_if("_modified").alias("modified")))
add("delete_many", "SELECT * FROM orders WHERE NOT (o_totalprice < 50000)", lambda s, d: M.delete_many(collection(s, d, "orders").df, {"o_totalprice": {"$lt": 50000}}))
add("delete_one", "SELECT * FROM nation WHERE n_nationkey <> (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 1)",
    lambda s, d: M.delete_one(collection(s, d, "nation").df, {"n_regionkey": 1}, ["n_nationkey"]))
add("insert_many", "SELECT * FROM region UNION ALL SELECT r_regionkey + 100, r_name || '2' FROM region",
    lambda s, d: (lambda r: M.insert_many(r, r.select((F.col("r_regionkey") + 100).alias("r_regionkey"), F.concat("r_name", F.lit("2")).alias("r_name")), ["r_regionkey"]))(collection(s, d, "region").df))
add("unique_violations", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    lambda s, d: M.unique_violations(collection(s, d, "lineitem").df, ["l_orderkey", "l_linenumber"]))
add("change_feed_before_after", "SELECT c_custkey, c_acctbal AS before, c_acctbal + 1 AS after FROM customer WHERE c_nationkey = 5",
    lambda s, d: M.changes(_cust(s, d), {"c_nationkey": 5}, {"$inc": {"c_acctbal": 1.0}}, C).select("c_custkey", F.col("before.c_acctbal").alias("before"), F.col("after.c_acctbal").alias("after")))
add("policy_constrained_find", "SELECT * FROM customer WHERE c_nationkey = 7 AND c_acctbal > 100 ORDER BY c_acctbal DESC, c_custkey LIMIT 50",
    lambda s, d: workspace("c_nationkey", 7, max_results=50).find(collection(s, d, "customer"), query({"c_acctbal": {"$gt": 100}}, [("c_acctbal", -1)], limit=500)))
add("policy_projected", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'MACHINERY'",
    lambda s, d: Policy(rows=query({"c_mktsegment": "MACHINERY"}).where, result_paths=("c_name",)).find(collection(s, d, "customer"), query(), ("c_custkey",)))


def _view_delta_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-20 view over events that arrive in four chunks of event_id: deltas between its snapshots, applied to the empty one."""
    events = collection(spark, sf_dir, "events")
    low, high = events.df.agg(F.min("event_id"), F.max("event_id")).first()
    old = held = (0, [])
    for k in range(1, 5 if low is not None else 1):
        seen = {"event_type": "purchase", "event_id": {"$lte": low + (high - low) * k // 4}}
        new = (k, [(r.event_id, r) for r in events.find(seen, sort=[("value", -1)], limit=20).collect()])
        delta = deltas.build(old, new)
        held, old = deltas.apply(held, delta) if delta.operations else (k, held[1]), new
    return spark.createDataFrame([r for _, r in held[1]], events.df.schema)


add("view_delta_apply", "SELECT * FROM events WHERE event_type = 'purchase' ORDER BY value DESC, event_id LIMIT 20", _view_delta_apply)


def _mixed(s: SparkSession, d: str) -> D.Documents:
    """Events as documents without a schema: v is missing or of one of nine kinds, t sometimes has k, o is an object or not."""
    e, n = collection(s, d, "events").df, F.col("event_id") % 11
    v = (
        F.when(n == 0, F.lit('"v":null,')).when(n == 1, F.concat(F.lit('"v":'), (F.col("event_id") % 2 == 0).cast("string"), F.lit(","))).when(n == 2, F.concat(F.lit('"v":'), (F.col("event_id") % 7).cast("string"), F.lit(",")))
        .when(n == 3, F.concat(F.lit('"v":'), (F.col("event_id") % 5).cast("string"), F.lit(".5e0,"))).when(n == 4, F.concat(F.lit('"v":"'), F.col("event_type"), F.lit('",')))
        .when(n == 5, F.concat(F.lit('"v":{"$date":'), (F.col("event_id") * 1000).cast("string"), F.lit("},"))).when(n == 6, F.concat(F.lit('"v":{"$id":"'), F.lpad(F.lower(F.hex("event_id")), 32, "0"), F.lit('"},')))
        .when(n == 7, F.concat(F.lit('"v":['), (F.col("event_id") % 3).cast("string"), F.lit(',"x",null],'))).when(n == 8, F.concat(F.lit('"v":{"k":'), (F.col("event_id") % 4).cast("string"), F.lit("},"))).otherwise("")
    )
    text = F.concat(F.lit("{"), v, F.lit('"props":'), F.when(F.col("event_id") % 6 == 0, F.lit("{}")).otherwise(F.col("props")), F.lit(',"type":"'), F.col("event_type"), F.lit('"}'))
    return D.Documents(D.from_json(e.select("event_id", text.alias("text")), "event_id", "text"))


_N = "event_id % 11"
_HAS = "(event_id % 6 <> 0)"
_K = "(props->>'k')::BIGINT"
for _name, _f, _sql in (
    ("filter_exists_true", {"v": {"$exists": True}}, f"{_N} < 9"), ("filter_exists_false", {"props.k": {"$exists": False}}, f"NOT {_HAS}"), ("filter_missing_or_null", {"$or": [{"v": None}, {"v": {"$exists": False}}]}, f"{_N} IN (0, 7, 9, 10)"),
    ("filter_type", {"v": {"$type": ["int64", "string", "object"]}}, f"{_N} IN (2, 4, 8)"), ("filter_type_number", {"v": {"$type": "float64"}}, f"{_N} = 3"), ("filter_type_special", {"v": {"$type": ["date", "id", "array"]}}, f"{_N} IN (5, 6, 7)"),
    ("filter_dotted_path_document", {"props.k": {"$gte": 50}}, f"{_HAS} AND {_K} >= 50"), ("filter_ne_mixed", {"v": {"$ne": 2}}, f"NOT ({_N} = 2 AND event_id % 7 = 2 OR {_N} = 7 AND event_id % 3 = 2)"),
    ("filter_range_mixed", {"v": {"$gte": 3, "$lt": "purchase"}}, f"({_N} = 2 AND event_id % 7 >= 3) OR ({_N} = 3 AND event_id % 5 + 0.5 >= 3) OR ({_N} = 4 AND event_type < 'purchase')"),
    ("filter_member_mixed", {"v": {"$in": [1, "click", None]}}, f"{_N} = 0 OR ({_N} = 2 AND event_id % 7 = 1) OR ({_N} = 4 AND event_type = 'click') OR {_N} = 7"),
    ("filter_size_mixed", {"v": {"$size": 3}}, f"{_N} = 7"), ("filter_object_equal", {"v": {"k": 2.0}}, f"{_N} = 8 AND event_id % 4 = 2"),
):
    add(_name, f"SELECT event_id AS id FROM events WHERE {_sql}", lambda s, d, f=_f: _mixed(s, d).find(f).select(F.col("_id").cast("long").alias("id")))
_ORDER = f"""CASE WHEN {_N} >= 9 THEN -1 ELSE [0, 1, 2, 2, 3, 4, 5, 7, 8][{_N} + 1] END, CASE {_N} WHEN 1 THEN (event_id % 2 = 0)::INT WHEN 2 THEN event_id % 7 WHEN 3 THEN event_id % 5 + 0.5 WHEN 5 THEN event_id ELSE 0 END,
  CASE {_N} WHEN 4 THEN event_type WHEN 6 THEN lpad(lower(hex(event_id)), 32, '0') ELSE '' END, event_id"""
add("sort_mixed_kinds", f"SELECT event_id AS id, rank FROM (SELECT event_id, row_number() OVER (ORDER BY {_ORDER}) AS rank FROM events) WHERE rank <= 900",
    lambda s, d: (lambda r: s.createDataFrame([(int(x._id), i + 1) for i, x in enumerate(r.collect())], "id long, rank long"))(_mixed(s, d).find(sort=[("v", 1)], limit=900).select("_id")))
add("group_count_mixed", f"SELECT CASE {_N} WHEN 2 THEN 'int64' WHEN 3 THEN 'float64' WHEN 1 THEN 'boolean' ELSE 'null' END AS kind, CASE {_N} WHEN 2 THEN (event_id % 7)::VARCHAR WHEN 3 THEN (event_id % 5)::VARCHAR || '.5' WHEN 1 THEN (event_id % 2 = 0)::VARCHAR ELSE 'null' END AS key, count(*) AS count FROM events WHERE {_N} IN (0, 1, 2, 3, 9, 10) GROUP BY 1, 2",
    lambda s, d: _mixed(s, d).group_count("v", {"$or": [{"v": {"$type": ["null", "boolean", "int64", "float64"]}}, {"v": {"$exists": False}}]}))
add("update_document", f"SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 1 + CASE WHEN {_HAS} THEN {_K} ELSE 0 END END AS k FROM events WHERE event_type = 'error'",
    lambda s, d: D.images(_mixed(s, d).find({"type": "error"}), [("$inc", "props.k", 1)]).select(F.col("_id").cast("long").alias("id"), F.get_json_object("after", "$.props.k").cast("long").alias("k")))


def _store(spark: SparkSession):
    from larkdoc.sources.store import Store
    from larkdoc.sources.tables import scratch

    return Store(spark, scratch(spark, "store"))


def _view_snapshot_after_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases arrive in four commits; a live top-20 view follows them through the change feed."""
    from larkdoc.sources.tables import scratch
    from larkdoc.streaming import views

    store, events = _store(spark), collection(spark, sf_dir, "events").df.where("event_type = 'purchase'")
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    view = views.View(store, "events", query({}, [("value", -1)], 0, 20))
    for k in range(4 if low is not None else 0):
        cut = [low + (high - low + 1) * j // 4 for j in (k, k + 1)]
        rows = events.where((F.col("event_id") >= cut[0]) & (F.col("event_id") < cut[1])).select("event_id", "value", (F.col("event_id") - cut[0]).alias("at"))
        docs = D.from_rows(rows, "event_id", F.col("at"))
        store.run(lambda t, docs=docs: t.insert_frame("events", docs))
    views.feed(store, lambda s, c: view.advance(s, c), scratch(spark, "checkpoint"), "events").awaitTermination()
    return spark.createDataFrame([(r["event_id"], float(r["value"])) for _, r in view.snapshot[1]], "event_id long, value double")


def _archive_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkdoc.sources import archive
    from larkdoc.sources.tables import scratch

    one, two, path = _store(spark), _store(spark), scratch(spark, "archive") + "/nation.jsonl"
    one.run(lambda t: t.insert_frame("nation", D.from_rows(collection(spark, sf_dir, "nation").df, "n_nationkey")))
    archive.export(one, path)
    archive.load(two, path)
    return two.read("nation").select(F.variant_get("doc", "$.n_nationkey", "int").alias("n_nationkey"), F.variant_get("doc", "$.n_name", "string").alias("n_name"), F.variant_get("doc", "$.n_regionkey", "int").alias("n_regionkey"))


add("view_snapshot_after_batches", "SELECT event_id, value FROM events WHERE event_type = 'purchase' ORDER BY value DESC, event_id LIMIT 20", _view_snapshot_after_batches)
add("archive_roundtrip", "SELECT n_nationkey, n_name, n_regionkey FROM nation", _archive_roundtrip)
