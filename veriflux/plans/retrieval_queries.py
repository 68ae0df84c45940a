"""Queries of retrieval: nearest neighbours, ranges, metadata, fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import squared_l2
from ..operators import knn as K
from ..operators import retrieval as R
from . import frames as S
from .registry import query


def d2_sql(a: str, b: str) -> str:
    return f"list_sum([(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) FOR z IN list_zip({a}, {b})])"


def nearest_sql(k: int, where: str = "TRUE", of: str = "q.vec_id % 20 = 0", name: str = "found") -> str:
    return f"""{name} AS (
  SELECT * FROM (
    SELECT q.vec_id AS query_id, b.vec_id, {d2_sql('q.embedding', 'b.embedding')} AS d2,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY {d2_sql('q.embedding', 'b.embedding')}, b.vec_id) AS rank
    FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id AND {where} WHERE {of}
  ) WHERE rank <= {k}
)"""


@query(f"WITH {nearest_sql(5)} SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, round(d2, 6) AS d2 FROM found")
def r1_knn_topk(spark, sf_dir):
    bank = S.bank(spark, sf_dir)
    return K.knn(S.queries_of(bank), bank, 5, exclude_self=True).withColumn("d2", F.round("d2", 6))


@query(f"WITH {nearest_sql(10, of='q.vec_id = 0')} SELECT vec_id, round(d2, 6) AS d2 FROM found")
def r2_single_topk(spark, sf_dir):
    bank = S.bank(spark, sf_dir)
    return K.knn(S.one_query(bank), bank, 10, exclude_self=True).select("vec_id", F.round("d2", 6).alias("d2"))


@query(f"SELECT q.vec_id AS query_id, b.vec_id, round({d2_sql('q.embedding', 'b.embedding')}, 6) AS d2 FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id WHERE q.vec_id % 20 = 0 AND {d2_sql('q.embedding', 'b.embedding')} < 1.5")
def r3_range_search(spark, sf_dir):
    bank = S.bank(spark, sf_dir)
    return K.range_search(S.queries_of(bank), bank, 1.5, exclude_self=True).withColumn("d2", F.round("d2", 6))


@query(f"WITH {nearest_sql(5, 'b.label = 3')} SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, round(d2, 6) AS d2 FROM found")
def r4_knn_filtered(spark, sf_dir):
    bank = S.bank(spark, sf_dir)
    return K.knn(S.queries_of(bank), bank, 5, exclude_self=True, subset=bank.filter("label = 3")).withColumn("d2", F.round("d2", 6))


@query()
def r5_ivf_topk(spark, sf_dir):
    bank = S.bank(spark, sf_dir)
    return K.IvfIndex(bank, nlist=16).search(S.queries_of(bank), 5, nprobe=12, exclude_self=True).withColumn("d2", F.round("d2", 6))


FILTERS = [("k", ">", 50), ("k", "<=", 95), ("k", "IN", [60, 61, 62, 63, 70, 90])]


def _event_nodes(spark, sf_dir):
    return S.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.col("props").alias("properties"))


META_SQL = """meta AS (
  SELECT event_id AS node_id, 1.0 AS score FROM events
  WHERE event_type IN ('click', 'error') AND CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50
    AND CAST(json_extract_string(props, '$.k') AS DOUBLE) <= 95 AND CAST(json_extract_string(props, '$.k') AS DOUBLE) IN (60, 61, 62, 63, 70, 90)
  ORDER BY event_id LIMIT 100
)"""


@query(f"WITH {META_SQL} SELECT node_id, CAST(score AS DOUBLE) AS score FROM meta")
def r6_metadata_filter(spark, sf_dir):
    return R.metadata_search(_event_nodes(spark, sf_dir), FILTERS, ["click", "error"])


def _vector_hits(spark, sf_dir, k=40):
    bank = S.bank(spark, sf_dir)
    found = K.knn(S.one_query(bank), bank, k, exclude_self=True)
    return found.select(F.col("vec_id").alias("node_id"), F.round("d2", 9).alias("distance"))


HITS_SQL = f"{nearest_sql(40, of='q.vec_id = 0')}, vec AS (SELECT vec_id AS node_id, round(d2, 9) AS distance FROM found)"


@query(f"""WITH {META_SQL}, {HITS_SQL}, top AS (SELECT greatest(1.0, max(distance)) AS t FROM vec)
SELECT coalesce(v.node_id, m.node_id) AS node_id, round(coalesce(0.7 * (1 - distance / (t + 1e-6)), 0) + coalesce((1 - 0.7) * m.score, 0), 6) AS fused
FROM (SELECT * FROM vec, top) v FULL OUTER JOIN meta m ON v.node_id = m.node_id""")
def r7_weighted_fusion(spark, sf_dir):
    meta = r6_metadata_filter(spark, sf_dir)
    return R.fuse_weighted(_vector_hits(spark, sf_dir), meta, 0.7).select("node_id", F.round("fused", 6).alias("fused"))


@query(f"""WITH {META_SQL}, {HITS_SQL},
a AS (SELECT node_id, row_number() OVER (ORDER BY distance, node_id) AS r FROM vec), b AS (SELECT node_id, row_number() OVER (ORDER BY node_id) AS r FROM meta)
SELECT coalesce(a.node_id, b.node_id) AS node_id, round(coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0), 9) AS fused FROM a FULL OUTER JOIN b ON a.node_id = b.node_id""")
def r8_rrf_fusion(spark, sf_dir):
    meta = r6_metadata_filter(spark, sf_dir)
    return R.fuse_rrf(_vector_hits(spark, sf_dir), meta).select("node_id", F.round("fused", 9).alias("fused"))


@query(f"""WITH {META_SQL}, bridge AS (SELECT vec_id, vec_id * 3 AS node_id FROM embeddings), sub AS (SELECT vec_id, node_id FROM bridge SEMI JOIN meta USING (node_id)), hit AS (
  SELECT s.node_id, round({d2_sql('q.embedding', 'b.embedding')}, 9) AS distance, row_number() OVER (ORDER BY {d2_sql('q.embedding', 'b.embedding')}, b.vec_id) AS r
  FROM embeddings q, embeddings b JOIN sub s ON s.vec_id = b.vec_id WHERE q.vec_id = 0
), vec AS (SELECT * FROM hit WHERE r <= 10), top AS (SELECT greatest(1.0, max(distance)) AS t FROM vec)
SELECT m.node_id, round(coalesce(0.5 * (1 - distance / (t + 1e-6)), 0) + 0.5 * m.score, 6) AS fused FROM meta m LEFT JOIN vec USING (node_id), top""")
def r9_hybrid(spark, sf_dir):
    bank = S.bank(spark, sf_dir)
    bridge = bank.select("vec_id", (F.col("vec_id") * 3).alias("node_id"))
    out = R.hybrid(S.one_query(bank), bank, bridge, _event_nodes(spark, sf_dir), k=10, filters=FILTERS, types=["click", "error"])
    return out.select("node_id", F.round("fused", 6).alias("fused"))


@query(f"""WITH {nearest_sql(3)} SELECT query_id, CAST(count(*) AS INTEGER) AS retrieval_count, CAST(max(CASE WHEN rank = 1 THEN vec_id END) AS BIGINT) AS top0_index, round(max(CASE WHEN rank = 1 THEN d2 END), 6) AS top0_distance,
 CAST(max(CASE WHEN rank = 2 THEN vec_id END) AS BIGINT) AS top1_index, round(max(CASE WHEN rank = 2 THEN d2 END), 6) AS top1_distance FROM found GROUP BY 1""")
def r10_retrieval_facts(spark, sf_dir):
    bank = S.bank(spark, sf_dir)
    found = K.knn(S.queries_of(bank), bank, 3, exclude_self=True)
    pick = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    return found.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("retrieval_count"), pick(1, "vec_id").alias("top0_index"), F.round(pick(1, "d2"), 6).alias("top0_distance"), pick(2, "vec_id").alias("top1_index"), F.round(pick(2, "d2"), 6).alias("top1_distance"))


@query(f"SELECT a.vec_id, round({d2_sql('a.embedding', 'b.embedding')}, 6) AS d2 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def f_squared_l2(spark, sf_dir):
    bank = S.bank(spark, sf_dir)
    nxt = bank.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return bank.join(nxt, "vec_id").select("vec_id", F.round(squared_l2("embedding", "other"), 6).alias("d2"))
