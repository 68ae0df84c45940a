"""Queries of the property graph and its change log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from . import frames as S
from .registry import query


def _walk_sql(start: str, rel: str, depth: int, a: str, b: str) -> str:
    return f"""WITH RECURSIVE {S.NODES_SQL}, {S.EDGES_SQL}, hop AS (SELECT DISTINCT {a} AS s, {b} AS t FROM edges WHERE relationship IN ({rel}) AND {b} IN (SELECT id FROM nodes)), walk(node_id, depth) AS (
  SELECT id, 0 FROM nodes WHERE {start} UNION SELECT t, depth + 1 FROM walk JOIN hop ON s = node_id WHERE depth < {depth}
) SELECT node_id, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY 1"""


def _starts(spark, sf_dir, condition):
    return S.nodes(spark, sf_dir).filter(condition).select("id")


@query(_walk_sql("type = 'orders'", "'CONTAINS', 'PLACED_BY', 'IN_NATION', 'IN_REGION'", 3, "source_id", "target_id"))
def g8_traverse_bfs(spark, sf_dir):
    return G.traverse(S.nodes(spark, sf_dir), S.edges(spark, sf_dir), _starts(spark, sf_dir, "type = 'orders'"), None, 3)


@query(_walk_sql("type = 'nation' AND name LIKE '%1%'", "'IN_NATION'", 3, "target_id", "source_id"))
def g9_reverse_traverse(spark, sf_dir):
    starts = S.nodes(spark, sf_dir).filter("type = 'nation' and get_json_object(properties, '$.name') like '%1%'").select("id")
    return G.traverse(S.nodes(spark, sf_dir), S.edges(spark, sf_dir), starts, "IN_NATION", 3, reverse=True)


@query(f"WITH {S.NODES_SQL}, {S.EDGES_SQL} SELECT n.id AS node_id, CAST(0 AS INTEGER) AS depth, count(*) AS targets FROM nodes n JOIN edges e ON e.target_id = n.id WHERE n.type = 'nation' AND relationship = 'IN_NATION' GROUP BY 1")
def g8_paths(spark, sf_dir):
    out = G.paths(S.nodes(spark, sf_dir), S.edges(spark, sf_dir), _starts(spark, sf_dir, "type = 'nation'"), "IN_NATION", 1, reverse=True)
    return out.select("node_id", "depth", F.size("targets").cast("long").alias("targets"))


@query(f"WITH {S.NODES_SQL} SELECT id, name FROM nodes WHERE type = 'supplier'")
def g6_find_by_type(spark, sf_dir):
    return S.nodes(spark, sf_dir).filter("type = 'supplier'").select("id", F.get_json_object("properties", "$.name").alias("name"))


@query(f"WITH {S.NODES_SQL}, {S.EDGES_SQL} SELECT 'nodes' AS what, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges")
def g10_counts(spark, sf_dir):
    n = S.nodes(spark, sf_dir).agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes").alias("what"), "n")
    return n.unionByName(S.edges(spark, sf_dir).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges").alias("what"), "n"))


def _log(spark, sf_dir):
    """Orders as versioned updates of their customers."""
    o = S.table(spark, sf_dir, "orders")
    return o.select(F.lit("customer").alias("entity_type"), F.col("o_custkey").alias("entity_id"), F.when(F.col("o_orderstatus") == "F", "Delete").otherwise("Update").alias("op"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderkey").alias("entry_id"))


LOG_SQL = """log AS (
  SELECT 'customer' AS entity_type, o_custkey AS entity_id, CASE WHEN o_orderstatus = 'F' THEN 'Delete' ELSE 'Update' END AS op, CAST(o_orderdate AS TIMESTAMP) AS ts, o_orderkey AS entry_id FROM orders
), v AS (SELECT *, CAST(row_number() OVER (PARTITION BY entity_type, entity_id ORDER BY ts, entry_id) AS INTEGER) AS version FROM log)"""


@query(f"WITH {LOG_SQL} SELECT entity_id, entry_id, op, version FROM v")
def g11_change_versions(spark, sf_dir):
    return G.versioned(_log(spark, sf_dir)).select("entity_id", "entry_id", "op", "version")


@query(f"WITH {LOG_SQL} SELECT entry_id, op, version FROM v WHERE entity_id = 7")
def g12_history(spark, sf_dir):
    return G.history(G.versioned(_log(spark, sf_dir)), "customer", 7).select("entry_id", "op", "version")


@query(f"WITH {LOG_SQL} SELECT entity_id, entry_id, op FROM log WHERE ts > TIMESTAMP '1997-06-01'")
def g13_changes_since(spark, sf_dir):
    return G.changes_since(_log(spark, sf_dir), "1997-06-01").select("entity_id", "entry_id", "op")


@query(f"WITH {LOG_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, entry_id DESC) AS n FROM log WHERE ts <= TIMESTAMP '1996-06-01') SELECT entity_id, entry_id, op FROM l WHERE n = 1 AND op <> 'Delete'")
def g15_as_of(spark, sf_dir):
    return G.as_of(_log(spark, sf_dir), "1996-06-01").select("entity_id", "entry_id", "op")


@query("SELECT event_id % 97 AS vec_index, arg_max(user_id, event_id) AS node_id FROM events GROUP BY 1")
def g16_link_embedding(spark, sf_dir):
    e = S.table(spark, sf_dir, "events")
    return G.link_embeddings(e.select((F.col("event_id") % 97).alias("vec_index"), F.col("user_id").alias("node_id"), F.col("event_id").alias("seq")))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS missing FROM events")
def g17_record_codec(spark, sf_dir):
    e = S.table(spark, sf_dir, "events")
    v = F.parse_json("props")
    return e.select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.try_variant_get(v, "$.none", "string").alias("missing"))


@query(f"""WITH {S.NODES_SQL}, {S.EDGES_SQL}, a AS (SELECT DISTINCT e.target_id AS id FROM nodes n JOIN edges e ON e.source_id = n.id AND relationship = 'IN_NATION' WHERE type = 'supplier'), b AS (SELECT DISTINCT target_id AS id FROM a JOIN edges e ON e.source_id = a.id AND relationship = 'IN_REGION')
SELECT 'graph.supplier.IN_NATION.IN_REGION.name' AS fact, arg_max(name, id) AS value, max(id) AS end_id FROM b JOIN nodes USING (id) WHERE name IS NOT NULL""")
def g18_path_property(spark, sf_dir):
    return G.resolve_path(S.nodes(spark, sf_dir), S.edges(spark, sf_dir), "supplier->IN_NATION->IN_REGION.name")
