"""How the concepts of inspection map on the given tables: frames, vectors, nodes, edges, rules and a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reasoner import load_tree
from ..operators.rules import load_rules
from ..sources.tables import table

RULES = """
rule_sets:
  defects:
    - {name: high_score, priority: 1, condition: {field: score, op: ">", value: 0.8}, action: {label: scratch, base_severity: 0.9}, overrides: [mid_score]}
    - name: mid_score
      priority: 9
      condition: {and: [{field: score, op: ">", value: 0.5}, {field: score, op: "<=", value: 0.95}]}
      action: {label: stain, base_severity: 0.5}
      overrides: [noisy]
    - {name: noisy, condition: {or: [{field: event_type, op: "==", value: error}, {field: k, op: ">=", value: 90}]}, action: {label: noise, base_severity: 0.3}}
  process:
    - {name: late_view, condition: {and: [{field: event_type, op: in, value: [view, click]}, {field: k, op: "<", value: 5}]}, action: {label: late}}
    - {name: missing_fact, condition: {or: [{field: ghost, op: ">", value: 1}, {field: score, op: ">", value: 0}]}, action: {label: never, base_severity: 1}}
    - name: odd_purchase
      condition: {and: [{field: event_type, op: "==", value: purchase}, {not: {field: score, op: "<", value: 0.9}}]}
      action: {label: odd, base_severity: 0.7}
      overridden_by: [noisy]
"""

TREE = """
tree:
  type: branch
  field: event_type
  branches:
    error:
      type: branch
      field: score
      branches:
        ">0.9": {type: leaf, label: NG, recommendation: stop, formulas: [{weights: [4.0, 0.01], features: [score, k], threshold: 3.0}, {weights: [2.0, 1.0], features: [score, ghost], threshold: 1.0}]}
        "<=0.2": {type: leaf, label: OK, recommendation: pass}
      default: {type: leaf, label: scratch, recommendation: look, formulas: [{weights: [4.0, 0.01], features: [score, k], threshold: 3.0}]}
    purchase: {type: leaf, label: review, recommendation: look, formulas: [{weights: [2.0, 1.0], features: [score, ghost], threshold: 1.0}]}
  default: {type: leaf, label: OK, recommendation: pass}
verdict_mapping: {ng: 0.7, warn: 0.3}
"""

#: CTEs of DuckDB for the same.
FRAMES_SQL = """frames AS (
  SELECT event_id AS frame_id, user_id AS surface_id, user_id % 4 AS position_id, value / 500 AS score,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, event_type, value, ts FROM events
)"""
RAW_SQL = """raw AS (
  SELECT *, score > 0.8 AS m_high, score > 0.5 AND score <= 0.95 AS m_mid, event_type = 'error' OR k >= 90 AS m_noisy,
    event_type IN ('view', 'click') AND k < 5 AS m_late, event_type = 'purchase' AND NOT score < 0.9 AS m_odd FROM frames
)"""
REASONED_SQL = """leaves AS (
  SELECT *, 1 / (1 + exp(-(4.0 * score + 0.01 * k - 3.0))) AS f1, 1 / (1 + exp(-(2.0 * score - 1.0))) AS f2 FROM raw
), leaf AS (
  SELECT *,
    CASE WHEN event_type = 'error' THEN CASE WHEN score <= 0.2 THEN 'OK' WHEN score > 0.9 THEN 'NG' ELSE 'scratch' END WHEN event_type = 'purchase' THEN 'review' ELSE 'OK' END AS label,
    CASE WHEN event_type = 'error' THEN CASE WHEN score <= 0.2 THEN 0.0 WHEN score > 0.9 THEN greatest(f1, f2) ELSE f1 END WHEN event_type = 'purchase' THEN f2 ELSE 0.0 END AS leaf_score,
    CASE WHEN event_type = 'error' THEN CASE WHEN score <= 0.2 THEN 'pass' WHEN score > 0.9 THEN 'stop' ELSE 'look' END WHEN event_type = 'purchase' THEN 'look' ELSE 'pass' END AS recommendation
  FROM leaves
), reasoned AS (
  SELECT *, CASE WHEN label IN ('NG', 'WARN', 'OK', 'UNCERTAIN') THEN label WHEN leaf_score > 0.7 THEN 'NG' WHEN leaf_score > 0.3 THEN 'WARN' ELSE 'OK' END AS verdict,
    round(leaf_score, 6) AS severity,
    m_mid AND NOT m_high AS r_mid, m_noisy AND NOT m_mid AS r_noisy, m_odd AND NOT m_noisy AS r_odd
  FROM leaf
)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(F.col("event_id").alias("frame_id"), F.col("user_id").alias("surface_id"), (F.col("user_id") % 4).alias("position_id"), (F.col("value") / 500).alias("score"), k.alias("k"), "event_type", "value", "ts")


def rules():
    return load_rules(RULES)


def tree():
    return load_tree(TREE)


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def queries_of(bank: DataFrame) -> DataFrame:
    """The query set: vectors whose id is divisible by 20."""
    return bank.filter(F.col("vec_id") % 20 == 0).select("vec_id", "embedding")


def one_query(bank: DataFrame) -> DataFrame:
    """The vector 0, for operators that search for one vector."""
    return bank.filter("vec_id = 0").select("vec_id", "embedding")


TYPES = ("region", "nation", "customer", "supplier", "orders", "part")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id = type number * 10**9 + key; properties as JSON."""
    props = {"region": ("r_regionkey", {"name": "r_name"}), "nation": ("n_nationkey", {"name": "n_name"}), "customer": ("c_custkey", {"segment": "c_mktsegment"}), "supplier": ("s_suppkey", {"name": "s_name"}), "orders": ("o_orderkey", {"status": "o_orderstatus"}), "part": ("p_partkey", {"brand": "p_brand"})}
    out = None
    for i, (kind, (key, fields)) in enumerate(props.items()):
        part = table(spark, sf_dir, kind).select((F.lit(i * 10**9) + F.col(key)).cast("long").alias("id"), F.lit(kind).alias("type"), F.to_json(F.struct(*[F.col(c).alias(n) for n, c in fields.items()])).alias("properties"))
        out = part if out is None else out.unionByName(part)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rel(name, source, s, target, t, df):
        return df.select((F.lit(TYPES.index(source) * 10**9) + F.col(s)).cast("long").alias("source_id"), (F.lit(TYPES.index(target) * 10**9) + F.col(t)).cast("long").alias("target_id"), F.lit(name).alias("relationship"))

    read = lambda n: table(spark, sf_dir, n)
    parts = [rel("IN_REGION", "nation", "n_nationkey", "region", "n_regionkey", read("nation")), rel("IN_NATION", "customer", "c_custkey", "nation", "c_nationkey", read("customer")), rel("IN_NATION", "supplier", "s_suppkey", "nation", "s_nationkey", read("supplier")), rel("PLACED_BY", "orders", "o_orderkey", "customer", "o_custkey", read("orders")), rel("CONTAINS", "orders", "l_orderkey", "part", "l_partkey", read("lineitem"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


NODES_SQL = """nodes AS (
  SELECT CAST(r_regionkey AS BIGINT) AS id, 'region' AS type, r_name AS name FROM region
  UNION ALL SELECT 1000000000 + n_nationkey, 'nation', n_name FROM nation
  UNION ALL SELECT 2000000000 + c_custkey, 'customer', NULL FROM customer
  UNION ALL SELECT 3000000000 + s_suppkey, 'supplier', s_name FROM supplier
  UNION ALL SELECT 4000000000 + o_orderkey, 'orders', NULL FROM orders
  UNION ALL SELECT 5000000000 + p_partkey, 'part', NULL FROM part
)"""
EDGES_SQL = """edges AS (
  SELECT 1000000000 + n_nationkey AS source_id, CAST(n_regionkey AS BIGINT) AS target_id, 'IN_REGION' AS relationship FROM nation
  UNION ALL SELECT 2000000000 + c_custkey, 1000000000 + c_nationkey, 'IN_NATION' FROM customer
  UNION ALL SELECT 3000000000 + s_suppkey, 1000000000 + s_nationkey, 'IN_NATION' FROM supplier
  UNION ALL SELECT 4000000000 + o_orderkey, 2000000000 + o_custkey, 'PLACED_BY' FROM orders
  UNION ALL SELECT 4000000000 + l_orderkey, 5000000000 + l_partkey, 'CONTAINS' FROM lineitem
)"""
