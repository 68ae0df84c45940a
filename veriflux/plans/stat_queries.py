"""Queries of bank statistics, scores and score maps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalised
from ..operators import image as I
from ..operators import knn as K
from ..operators import stats as V
from . import frames as S
from .registry import query
from .retrieval_queries import d2_sql, nearest_sql


@query("WITH n AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings) SELECT vec_id FROM n WHERE i % (n // 120) = 0 AND i < (n // 120) * 120")
def v1_stride_sample(spark, sf_dir):
    return V.stride_sample(S.bank(spark, sf_dir), 120, "vec_id").select("vec_id")


def _pool_sql(f: str) -> str:
    return f"SELECT label, CAST(pos - 1 AS INTEGER) AS pos, round({f}(CAST(x AS DOUBLE)), 6) AS value FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) GROUP BY 1, 2"


@query(_pool_sql("avg"))
def v8_pool_avg(spark, sf_dir):
    return V.pooled(S.bank(spark, sf_dir), "label", "avg").withColumn("value", F.round("value", 6))


@query(_pool_sql("max"))
def v8_pool_max(spark, sf_dir):
    return V.pooled(S.bank(spark, sf_dir), "label", "max").withColumn("value", F.round("value", 6))


@query("SELECT vec_id, round(list_sum([CAST(x AS DOUBLE) FOR x IN embedding]) / sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) FOR x IN embedding])), 6) AS total FROM embeddings")
def v10_l2_normalize(spark, sf_dir):
    unit = l2_normalised("embedding")
    return S.bank(spark, sf_dir).select("vec_id", F.round(F.aggregate(unit, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


#: Fixed parameters for the scores: a mean and two orthonormal components of 64 dimensions.
MEAN, C1, C2, EIGEN = [0.01] * 64, [0.125] * 64, [0.125, -0.125] * 32, [0.5, 0.25]
PCA_SQL = """x AS (SELECT vec_id, [CAST(v AS DOUBLE) FOR v IN embedding] AS e FROM embeddings), z AS (
  SELECT vec_id, e, list_sum([(v - 0.01) * (v - 0.01) FOR v IN e]) AS xx, list_sum([(v - 0.01) * 0.125 FOR v IN e]) AS z1,
    list_sum([(v - 0.01) * CASE WHEN i % 2 = 1 THEN 0.125 ELSE -0.125 END FOR v, i IN e]) AS z2 FROM x
), r AS (SELECT *, [0.01 + 0.125 * z1 + CASE WHEN i % 2 = 1 THEN 0.125 ELSE -0.125 END * z2 FOR v, i IN e] AS recon FROM z)"""


def _pca(name: str):
    def run(spark, sf_dir):
        scores = V.pca_scores(F.col("embedding"), MEAN, [C1, C2], EIGEN)
        return S.bank(spark, sf_dir).select("vec_id", F.round(scores[name], 6).alias("score"))

    return run


for _name, _short, _sql in (
    ("reconstruction", "recon", "greatest(0, xx - (z1 * z1 + z2 * z2))"),
    ("mahalanobis", "mahal", "z1 * z1 / (0.5 + 1e-6) + z2 * z2 / (0.25 + 1e-6)"),
    ("euclidean", "euclid", "z1 * z1 + z2 * z2"),
    ("cosine", "cosine", "1 - list_sum([p[1] * p[2] FOR p IN list_zip(e, recon)]) / greatest(sqrt(list_sum([v * v FOR v IN e])) * sqrt(list_sum([v * v FOR v IN recon])), 1e-8)"),
):
    _f = _pca(_name)
    _f.__name__ = f"v9_pca_{_short}"
    query(f"WITH {PCA_SQL} SELECT vec_id, round({_sql}, 6) AS score FROM r")(_f)


def _kth(spark, sf_dir, k=2):
    return V.kth_distances(S.bank(spark, sf_dir), k).withColumn("d2", F.round("d2", 9))


KTH_SQL = nearest_sql(2, of='TRUE') + ", kth AS (SELECT query_id AS vec_id, round(max(d2), 9) AS d2 FROM found GROUP BY 1), s AS (SELECT d2, row_number() OVER (ORDER BY d2) - 1 AS i, count(*) OVER () AS n FROM kth)"


@query(f"WITH {KTH_SQL} SELECT round(max(CASE WHEN i = floor(0.99 * (n - 1) + 1e-9) THEN d2 END), 6) AS threshold, round(max(d2), 6) AS reference, round(max(CASE WHEN i = floor(0.99 * (n - 1) + 1e-9) THEN d2 END) / max(d2), 6) AS effective FROM s")
def v12_adaptive_threshold(spark, sf_dir):
    out = V.adaptive_threshold(_kth(spark, sf_dir))
    return out.select(*[F.round(c, 6).alias(c) for c in ("threshold", "reference", "effective")])


PICK = "max(CASE WHEN i = floor({} * (n - 1) + 1e-9) THEN d2 END)"
PROFILE_SQL = f"{KTH_SQL}, p AS (SELECT {PICK.format(0.5)} AS p50, {PICK.format(0.95)} AS p95, {PICK.format(0.99)} AS p99, avg(d2) AS mean, stddev_pop(d2) AS stddev FROM s)"


@query(f"WITH {PROFILE_SQL} SELECT round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99, 6) AS p99, round(mean, 6) AS mean, round(stddev, 6) AS stddev, round(1 - least(1, (SELECT avg(CASE WHEN d2 > p95 THEN 1.0 ELSE 0.0 END) FROM kth) / 0.1), 6) AS self_normalcy FROM p")
def m1_normality_profile(spark, sf_dir):
    out = V.normality_profile(_kth(spark, sf_dir))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def _frames(spark, sf_dir):
    return _kth(spark, sf_dir).join(S.bank(spark, sf_dir).select("vec_id", "label"), "vec_id")


FRAME_SQL = f"""WITH {PROFILE_SQL}, f AS (
  SELECT label, d2, row_number() OVER (PARTITION BY label ORDER BY d2) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM kth JOIN embeddings USING (vec_id)
), g AS (
  SELECT label, max(CASE WHEN i = n // 2 THEN d2 END) / max(p50) AS concentration, avg(CASE WHEN d2 > p95 THEN 1.0 ELSE 0.0 END) AS tail, avg(CASE WHEN d2 < p50 THEN 1.0 ELSE 0.0 END) AS coverage FROM f, p GROUP BY 1
) """


def _normalcy(spark, sf_dir):
    p = V.normality_profile(_kth(spark, sf_dir)).first()
    return V.frame_normalcy(_frames(spark, sf_dir), "label", p.p50, p.p95)


@query(FRAME_SQL + "SELECT label, round(concentration, 6) AS concentration, round(tail, 6) AS tail, round(1 - least(1, tail / 0.1), 6) AS normalcy FROM g")
def m4_normalcy(spark, sf_dir):
    return _normalcy(spark, sf_dir).select("label", *[F.round(c, 6).alias(c) for c in ("concentration", "tail", "normalcy")])


@query(FRAME_SQL + "SELECT label, round(coverage, 6) AS coverage, coverage < 0.6 AS novel FROM g")
def m5_novelty(spark, sf_dir):
    return _normalcy(spark, sf_dir).select("label", F.round("coverage", 6).alias("coverage"), "novel")


@query(FRAME_SQL + "SELECT label, round(1 - least(1, tail / 0.1), 9) >= 0.4 AND concentration < 1.01 AND label % 3 <> 0 AS agreed FROM g")
def m6_consensus(spark, sf_dir):
    rules, verdict = F.lit(0), F.when(F.col("label") % 3 == 0, "NG").otherwise("OK")
    return _normalcy(spark, sf_dir).select("label", V.consensus(F.round("normalcy", 9), F.col("concentration"), rules, verdict, 1.01, 0.4).alias("agreed"))


@query("""WITH d AS (SELECT event_type, date_trunc('day', ts) AS day, avg(value) AS value FROM events GROUP BY 1, 2), w AS (
  SELECT event_type, day, value, avg(value) OVER b AS m, stddev_pop(value) OVER b AS s, count(*) OVER b AS n, min(value) OVER r AS least FROM d
  WINDOW b AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN CURRENT ROW AND CURRENT ROW))
SELECT event_type, strftime(day, '%Y-%m-%d') AS day, n = 4 AND least > m + 1.0 * s AS drift FROM w""")
def m13_drift_flags(spark, sf_dir):
    d = S.table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("value"))
    return V.drift(d, ["event_type"], "day", "value", window=4, last=1, sigmas=1.0).select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), "drift")


@query(f"WITH {nearest_sql(1, of='TRUE')}, r AS (SELECT max(d2) AS ref FROM found) SELECT query_id AS vec_id, round(d2 / ref, 6) AS score FROM found, r")
def v11_patch_score(spark, sf_dir):
    bank = S.bank(spark, sf_dir)
    d = K.knn(bank.select("vec_id", "embedding"), bank, 1, exclude_self=True)
    return d.crossJoin(F.broadcast(d.agg(F.max("d2").alias("ref")))).select(F.col("query_id").alias("vec_id"), F.round(F.col("d2") / F.col("ref"), 6).alias("score"))  # one row


@query(f"WITH {nearest_sql(1, of='TRUE')}, {PCA_SQL} SELECT f.query_id AS vec_id, round(0.5 * d2 + 0.5 * pca / top, 6) AS score FROM (SELECT f.query_id, f.d2, z1 * z1 + z2 * z2 AS pca, max(z1 * z1 + z2 * z2) OVER (PARTITION BY e2.label) AS top FROM found f JOIN r ON r.vec_id = f.query_id JOIN embeddings e2 ON e2.vec_id = f.query_id) f")
def v13_hybrid_score(spark, sf_dir):
    from pyspark.sql import Window

    bank = S.bank(spark, sf_dir)
    d = K.knn(bank.select("vec_id", "embedding"), bank, 1, exclude_self=True).select(F.col("query_id").alias("vec_id"), "d2")
    pca = bank.select("vec_id", "label", V.pca_scores(F.col("embedding"), MEAN, [C1, C2], EIGEN)["euclidean"].alias("pca"))
    top = F.max("pca").over(Window.partitionBy("label"))
    return d.join(pca, "vec_id").select("vec_id", F.round(0.5 * F.col("d2") + 0.5 * F.try_divide(F.col("pca"), top), 6).alias("score"))


def _maps(spark, sf_dir):
    return S.bank(spark, sf_dir).select(F.col("vec_id").alias("frame_id"), F.transform("embedding", lambda x: x.cast("double")).alias("scores"))


@query("""WITH c AS (SELECT vec_id AS frame_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS s FROM embeddings), g AS (SELECT unnest(range(16)) AS o), a AS (
  SELECT o, greatest(0, least(7, (o + 0.5) / 2 - 0.5)) AS p FROM g), b AS (SELECT o, CAST(floor(p) AS INTEGER) AS lo, least(CAST(floor(p) AS INTEGER) + 1, 7) AS hi, p - floor(p) AS f FROM a)
SELECT frame_id, CAST(y.o AS INTEGER) AS y, CAST(x.o AS INTEGER) AS x, round((s[y.lo * 8 + x.lo + 1] * (1 - x.f) + s[y.lo * 8 + x.hi + 1] * x.f) * (1 - y.f) + (s[y.hi * 8 + x.lo + 1] * (1 - x.f) + s[y.hi * 8 + x.hi + 1] * x.f) * y.f, 6) AS value
FROM c, b y, b x""")
def i13_upsample(spark, sf_dir):
    import pandas as pd

    I.ship_package(spark)

    def run(batches):
        for pdf in batches:
            for k, s in zip(pdf["frame_id"], pdf["scores"]):
                out = I.upsample(np.asarray(s).reshape(8, 8), 16, 16)
                yield pd.DataFrame({"frame_id": k, "y": np.repeat(np.arange(16), 16), "x": np.tile(np.arange(16), 16), "value": out.ravel().round(6)})

    return _maps(spark, sf_dir).mapInPandas(run, "frame_id long, y int, x int, value double")
