"""Queries of detectors, facts, coresets and PCA."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import detect as D
from ..operators import facts as B
from ..operators import knn as K
from ..operators import linalg as L
from ..operators import stats as V
from ..streaming import bootstrap as T
from ..streaming import recorder as R
from . import frames as S
from .image_queries import regions_sql
from .registry import query
from .retrieval_queries import d2_sql
from .stat_queries import C1, C2, EIGEN, FRAME_SQL, MEAN, PCA_SQL, _kth, _normalcy

#: Each label's first 16 vectors make one frame's 4 x 4 patches; the bank of a label is every other vector of it, and labels 7 to 9 have none.
PATCH_SQL = """numbered AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n FROM embeddings), patch AS (
  SELECT CAST(label AS BIGINT) AS frame_id, n AS patch, vec_id, embedding, label % 3 AS surface_id, label AS position_id FROM numbered WHERE n < 16 AND (label <> 4 OR n <> 5)
), bank AS (SELECT * FROM numbered WHERE n % 2 = 1)"""
GRID = "grid_ok AS (SELECT frame_id, count(*) = 16 AS ok FROM patch GROUP BY 1)"


def _numbered(spark, sf_dir):
    from pyspark.sql import Window

    bank = S.bank(spark, sf_dir)
    return bank.withColumn("n", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long"))


def _patches(spark, sf_dir):
    """Frame 4 lacks a patch."""
    p = _numbered(spark, sf_dir).filter("n < 16 and (label <> 4 or n <> 5)")
    return p.select(F.col("label").cast("long").alias("frame_id"), F.col("n").alias("patch"), "embedding", (F.col("label") % 3).alias("surface_id"), F.col("label").alias("position_id"))


def _banks(spark, sf_dir):
    return _numbered(spark, sf_dir).filter("n % 2 = 1").select((F.col("label") % 3).alias("surface_id"), F.col("label").alias("position_id"), "vec_id", "embedding")


def _scores(out):
    areas = out.groupBy("frame_id").agg(F.first("error").isNotNull().alias("failed"), F.round(F.max("image_score"), 6).alias("image_score"), F.count("region").alias("regions"), F.coalesce(F.sum("area"), F.lit(0)).cast("long").alias("area"))
    return areas


def _scores_sql(cells: str, threshold: float) -> str:
    """Of scores (frame_id, patch, score) of whole frames, and frames that failed."""
    return f"""cells AS (SELECT frame_id, patch // 4 AS y, patch % 4 AS x, score AS value FROM {cells}), {regions_sql('cells', threshold)}
SELECT f.frame_id, failed, round(image_score, 6) AS image_score, count(region) AS regions, CAST(coalesce(sum(area), 0) AS BIGINT) AS area FROM (SELECT frame_id, bool_or(failed) AS failed, CASE WHEN NOT bool_or(failed) THEN max(score) END AS image_score FROM {cells}_all GROUP BY 1) f LEFT JOIN regions r ON r.frame_id = f.frame_id GROUP BY ALL"""


CFG = D.DetectorConfig(grid=(4, 4), size=(4, 4), sigma=0.0, threshold=0.5, reference=1.6)


@query(f"""WITH RECURSIVE {PATCH_SQL}, {GRID}, s_all AS (SELECT p.frame_id, p.patch, min({d2_sql('p.embedding', 'b.embedding')}) / 1.6 AS score, NOT any_value(ok) AS failed FROM patch p JOIN grid_ok USING (frame_id), bank b GROUP BY 1, 2), s AS (SELECT * FROM s_all WHERE NOT failed),
{_scores_sql('s', 0.5)}""")
def v15_knn_detect(spark, sf_dir):
    return _scores(D.knn_detect(_patches(spark, sf_dir), _banks(spark, sf_dir).select("vec_id", "embedding"), CFG))


@query(f"""WITH RECURSIVE {PATCH_SQL}, {GRID}, d AS (SELECT p.frame_id, p.patch, min({d2_sql('p.embedding', 'b.embedding')}) / 1.6 AS score, coalesce(NOT any_value(ok), TRUE) AS failed FROM patch p JOIN grid_ok USING (frame_id) JOIN bank b ON b.label = p.position_id WHERE p.position_id < 7 GROUP BY 1, 2
UNION ALL SELECT p.frame_id, p.patch, min({d2_sql('p.embedding', 'b.embedding')}) / 1.6, NOT any_value(ok) FROM patch p JOIN grid_ok USING (frame_id), bank b WHERE p.position_id >= 7 AND b.label = 0 GROUP BY 1, 2), s_all AS (SELECT * FROM d), s AS (SELECT * FROM d WHERE NOT failed),
{_scores_sql('s', 0.5)}""")
def v17_multi_bank(spark, sf_dir):
    """Frames of positions 7 to 9 have no bank of their own and go to the default one, of label 0."""
    banks = _banks(spark, sf_dir)
    return _scores(D.knn_detect(_patches(spark, sf_dir), banks.filter("position_id < 7"), CFG, keys=("surface_id", "position_id"), default=banks.filter("position_id = 0").select("vec_id", "embedding")))


def _model():
    return L.Pca(np.array(MEAN), np.array([C1, C2]), np.array(EIGEN))


@query(f"""WITH RECURSIVE {PATCH_SQL}, {GRID}, {PCA_SQL}, q AS (SELECT p.frame_id, p.patch, z1 * z1 + z2 * z2 AS pca, NOT ok AS failed FROM patch p JOIN grid_ok USING (frame_id) JOIN z ON z.vec_id = p.vec_id),
s_all AS (SELECT frame_id, patch, pca / max(pca) OVER (PARTITION BY frame_id) AS score, failed FROM q), s AS (SELECT * FROM s_all WHERE NOT failed), {_scores_sql('s', 0.4)}""")
def v16_pca_detect(spark, sf_dir):
    cfg = D.DetectorConfig(grid=(4, 4), size=(4, 4), sigma=0.0, threshold=0.4, method="euclidean")
    return _scores(D.pca_detect(_patches(spark, sf_dir), _model(), cfg))


@query(f"""WITH RECURSIVE {PATCH_SQL}, {GRID}, {PCA_SQL}, q AS (SELECT p.frame_id, p.patch, min({d2_sql('p.embedding', 'b.embedding')}) / 1.6 AS d, any_value(z1 * z1 + z2 * z2) AS pca, NOT any_value(ok) AS failed FROM patch p JOIN grid_ok USING (frame_id) JOIN z ON z.vec_id = p.vec_id, bank b GROUP BY 1, 2),
s_all AS (SELECT frame_id, patch, 0.7 * d + (1 - 0.7) * pca / max(pca) OVER (PARTITION BY frame_id) AS score, failed FROM q), s AS (SELECT * FROM s_all WHERE NOT failed), {_scores_sql('s', 0.45)}""")
def v13_hybrid_detect(spark, sf_dir):
    cfg = D.DetectorConfig(grid=(4, 4), size=(4, 4), sigma=0.0, threshold=0.45, reference=1.6, alpha=0.7, method="euclidean")
    return _scores(D.knn_detect(_patches(spark, sf_dir), _banks(spark, sf_dir).select("vec_id", "embedding"), cfg, pca=_model()))


@query(f"""WITH f AS (SELECT q.label, q.vec_id AS query_id, b.vec_id, {d2_sql('q.embedding', 'b.embedding')} AS d2, row_number() OVER (PARTITION BY q.vec_id ORDER BY {d2_sql('q.embedding', 'b.embedding')}, b.vec_id) AS rank FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id AND q.label = b.label)
SELECT label, query_id, vec_id, CAST(rank AS INTEGER) AS rank, round(d2, 6) AS d2 FROM f WHERE rank <= 2""")
def r1_knn_join(spark, sf_dir):
    """All vectors against their label's, in blocks that are dealt out."""
    bank = S.bank(spark, sf_dir)
    return K.knn_join(bank.withColumnRenamed("vec_id", "query_id"), bank, 2, ("label",), exclude_self=True, block=24).withColumn("d2", F.round("d2", 6))


@query(f"""WITH {PATCH_SQL}, c AS (SELECT * FROM embeddings WHERE vec_id % 10 = 0), d AS (SELECT e.vec_id, sqrt(min({d2_sql('e.embedding', 'c.embedding')})) AS d FROM embeddings e, c GROUP BY 1) SELECT round(min(d), 6) AS least, round(avg(d), 6) AS mean, round(max(d), 6) AS largest FROM d""")
def v3_coverage(spark, sf_dir):
    bank = S.bank(spark, sf_dir)
    return L.coverage(bank, bank.filter("vec_id % 10 = 0")).select(*[F.round(c, 6).alias(c) for c in ("least", "mean", "largest")])


def _greedy_sql(n: int) -> str:
    """``n`` picks of each label, each the furthest from those before."""
    d2 = d2_sql("e.embedding", "p.embedding")
    steps = ["p0 AS (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY 1)", f"d0 AS (SELECT e.label, e.vec_id, CASE WHEN e.vec_id = p.vec_id THEN -1 ELSE {d2} END AS d FROM embeddings e JOIN p0 USING (label) JOIN embeddings p ON p.vec_id = p0.vec_id)"]
    for i in range(1, n):
        steps += [f"p{i} AS (SELECT label, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d DESC, vec_id) AS r FROM d{i - 1}) WHERE r = 1)", f"d{i} AS (SELECT e.label, e.vec_id, CASE WHEN e.vec_id = p.vec_id THEN -1 ELSE least(d, {d2}) END AS d FROM d{i - 1} b JOIN embeddings e ON e.vec_id = b.vec_id JOIN p{i} ON p{i}.label = e.label JOIN embeddings p ON p.vec_id = p{i}.vec_id)"]
    return "WITH " + ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT label, vec_id, CAST({i} AS INTEGER) AS pick FROM p{i}" for i in range(n))


@query(_greedy_sql(10))
def v2_greedy_coreset(spark, sf_dir):
    return L.greedy_coreset(S.bank(spark, sf_dir), 10, "label")


IDENTITY = "SELECT CAST(a AS INTEGER) AS i, CAST(b AS INTEGER) AS j, CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM range({0}) r(a), range({0}) s(b)"


def _covariance(rows, ddof=0):
    """i, j, value: the covariance of the embeddings; rounded, and without a sign at 0."""
    spark = rows.sparkSession
    n, _, scatter = L.moments(rows)
    c = np.round(scatter / (n - ddof), 5) + 0.0
    return spark.createDataFrame([(i, j, float(c[i, j])) for i in range(len(c)) for j in range(len(c))], "i int, j int, value double")


@query(IDENTITY.format(4))
def v6_whitened_covariance(spark, sf_dir):
    bank = S.bank(spark, sf_dir)
    return _covariance(L.project(bank, L.fit_whitening(bank, 4)))


@query("SELECT CAST(a AS INTEGER) AS i, CAST(b AS INTEGER) AS j, CASE WHEN a = b THEN TRUE ELSE FALSE END AS one FROM range(5) r(a), range(5) s(b)")
def v14_whitened_bank(spark, sf_dir):
    """Three components are dropped and five kept; each has a variance of nearly 1, as 1e-6 is added to it, and none goes with another."""
    _, white = L.whitened_bank(S.bank(spark, sf_dir), drop_k=3, k=5)
    return _covariance(white).select("i", "j", (F.abs(F.col("value") - 1) < 0.001).alias("one")).filter("one or i <> j")


@query("WITH v AS (SELECT pos, var_samp(CAST(x AS DOUBLE)) AS s, var_pop(CAST(x AS DOUBLE)) AS p FROM (SELECT unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY 1) SELECT round(sum(p), 6) AS total, round(sum(s), 6) AS total_sample, 0.0::DOUBLE AS error, TRUE AS falling FROM v")
def v4_pca_total(spark, sf_dir):
    """All components hold all of the variance, and give the vectors back (V4, V5, V7); the largest come first."""
    bank = S.bank(spark, sf_dir)
    p, s = L.fit_pca(bank, 64), L.fit_pca(bank, 64, ddof=1)
    z = L.project(bank, p.components, p.mean)
    back = L.project(z, p.components.T).withColumnRenamed("embedding", "back")
    mean = F.array(*[F.lit(float(v)) for v in p.mean])
    gap = F.aggregate(F.zip_with(F.zip_with("embedding", mean, lambda a, b: a - b), F.col("back"), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, b: F.greatest(a, b))
    error = bank.join(back, "vec_id").agg(F.round(F.max(gap), 5).alias("error"))
    falling = bool((np.diff(p.eigenvalues) <= 1e-12).all())
    return error.select(F.lit(round(float(p.eigenvalues.sum()), 6)).alias("total"), F.lit(round(float(s.eigenvalues.sum()), 6)).alias("total_sample"), (F.col("error") + 0.0).alias("error"), F.lit(falling).alias("falling"))


@query(f"WITH {PCA_SQL} SELECT vec_id, round(z1, 6) AS first, round(z2, 6) AS second FROM z")
def v7_project(spark, sf_dir):
    p = _model()
    out = L.project(S.bank(spark, sf_dir), p.components, p.mean)
    return out.select("vec_id", F.round(F.get("embedding", F.lit(0)), 6).alias("first"), F.round(F.get("embedding", F.lit(1)), 6).alias("second"))


@query("SELECT CAST(i AS INTEGER) AS i, CAST(CASE WHEN i = 0 THEN 0.4 ELSE 0.8 * i / 4 END AS DOUBLE) AS consensus, CAST(CASE WHEN i = 0 THEN 0.3 ELSE 0.7 * i / 4 END AS DOUBLE) AS evolution FROM range(5) r(i)".replace("0.8 * i / 4", "round(0.8 * i / 4, 9)").replace("0.7 * i / 4", "round(0.7 * i / 4, 9)"))
def m3_gates(spark, sf_dir):
    consensus, evolution = V.gates(F.col("i") / 4)
    return spark.range(5).select(F.col("id").cast("int").alias("i")).select("i", F.round(consensus, 9).alias("consensus"), F.round(evolution, 9).alias("evolution"))


@query("""WITH n AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings), s AS (SELECT vec_id, embedding FROM n WHERE i % (n // 100) = 0 AND i < (n // 100) * 100), d AS (
  SELECT q.vec_id, """ + d2_sql("q.embedding", "b.embedding") + """ AS d2, row_number() OVER (PARTITION BY q.vec_id ORDER BY """ + d2_sql("q.embedding", "b.embedding") + """, b.vec_id) AS r FROM s q JOIN s b ON q.vec_id <> b.vec_id
), k AS (SELECT d2, row_number() OVER (ORDER BY d2) - 1 AS i, count(*) OVER () AS n FROM d WHERE r = 5)
SELECT round(max(CASE WHEN i = floor(0.5 * (n - 1) + 1e-9) THEN d2 END), 6) AS p50, round(max(CASE WHEN i = floor(0.95 * (n - 1) + 1e-9) THEN d2 END), 6) AS p95, round(avg(d2), 6) AS mean, round(stddev_pop(d2), 6) AS stddev FROM k""")
def m2_fast_profile(spark, sf_dir):
    sample = V.stride_sample(S.bank(spark, sf_dir), 100, "vec_id")
    out = V.normality_profile(V.kth_distances(sample, 5))
    return out.select(*[F.round(c, 6).alias(c) for c in ("p50", "p95", "mean", "stddev")])


@query("""WITH d AS (SELECT event_type, date_trunc('day', ts) AS day, avg(value) AS value FROM events GROUP BY 1, 2), w AS (
  SELECT event_type, day, avg(value) OVER b AS m, stddev_pop(value) OVER b AS s, count(*) OVER b AS n, min(value) OVER r AS least FROM d
  WINDOW b AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 7 PRECEDING AND 3 PRECEDING), r AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT event_type, strftime(day, '%Y-%m-%d') AS day, n = 5 AND least > m + 2 * s AS drift FROM w""")
def m13_drift_default(spark, sf_dir):
    d = S.table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("value"))
    return V.drift(d, ["event_type"], "day", "value").select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), "drift")


@query(FRAME_SQL + ", r AS (SELECT round(1 - least(1, (SELECT avg(CASE WHEN d2 > p95 THEN 1.0 ELSE 0.0 END) FROM kth) / 0.1), 9) AS sn FROM p) SELECT label, round(1 - least(1, tail / 0.1), 9) >= round(CASE WHEN sn <= 0 THEN 0.4 ELSE 0.8 * sn END, 9) AND concentration < 1.01 AND label % 4 <> 0 AND label % 3 <> 0 AS agreed, coverage < 0.6 AS novel FROM g, r")
def m7_offer(spark, sf_dir):
    from types import SimpleNamespace

    from ..streaming import evolution as E

    own = V.normality_profile(_kth(spark, sf_dir)).first()
    frames = _normalcy(spark, sf_dir).withColumns({"normalcy": F.round("normalcy", 9), "image_score": F.col("concentration"), "n_rules": (F.col("label") % 4 == 0).cast("int"), "verdict": F.when(F.col("label") % 3 == 0, "NG").otherwise("OK")}).drop("novel")
    out = E.assessed(frames, SimpleNamespace(self_normalcy=round(own.self_normalcy, 9)), 1.01, E.EvolutionConfig())
    return out.select("label", "agreed", "novel")


@query("WITH f AS (SELECT user_id % 5 AS bank_key, event_id, value / 500 AS coverage FROM events), w AS (SELECT bank_key, event_id, count(*) OVER s = 3 AND min(coverage) OVER s >= 0.5 AS paused FROM f WINDOW s AS (PARTITION BY bank_key ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) SELECT * FROM w")
def m7_saturation(spark, sf_dir):
    from ..streaming import evolution as E

    f = S.table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("bank_key"), "event_id", (F.col("value") / 500).alias("coverage"))
    return E.saturated(f, "event_id", E.EvolutionConfig(saturation_window=3, saturation_coverage=0.5)).select("bank_key", "event_id", "paused")


FACT_CELLS = "c AS (SELECT vec_id AS frame_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS s FROM embeddings), cells AS (SELECT frame_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, s[i + 1] AS value FROM c, range(64) r(i))"


@query(f"""WITH RECURSIVE {FACT_CELLS}, {regions_sql('cells', 0.1)}, one AS (SELECT frame_id, list_max(s) AS top, count(region) AS n FROM c LEFT JOIN regions USING (frame_id) GROUP BY ALL), f AS (
  SELECT frame_id, unnest(['detection.image_level_score', 'detection.anomaly_map.max_score', 'detection.latency_ns', 'detection.grid_h', 'detection.grid_w', 'detection.region_count']) AS key, unnest([top, top, 0, 8, 8, n]) AS number FROM one
  UNION ALL SELECT frame_id, unnest(['detection.region.0.max_score', 'detection.region.0.mean_score', 'detection.region.0.area_pixels', 'detection.region.0.x', 'detection.region.0.y', 'detection.region.0.width', 'detection.region.0.height']), unnest([max_score, mean_score, area, x0, y0, w, h]) FROM regions WHERE region = 0
) SELECT frame_id, key, round(CAST(number AS DOUBLE), 6) AS number FROM f""")
def e16_detection_facts(spark, sf_dir):
    return B.detection_facts(_detections(spark, sf_dir), (8, 8)).select("frame_id", "key", F.round("number", 6).alias("number"))


def _detections(spark, sf_dir):
    from ..operators import image as I
    from .stat_queries import _maps

    return I.detect(_maps(spark, sf_dir), (8, 8), (8, 8), 0.0, 0.1)


@query(f"""WITH {S.NODES_SQL}, {S.EDGES_SQL}, v AS (SELECT arg_max(t.name, t.id) AS name FROM nodes n JOIN edges e ON e.source_id = n.id AND relationship = 'IN_REGION' JOIN nodes t ON t.id = e.target_id WHERE n.type = 'nation')
SELECT e.vec_id AS frame_id, CAST(e.label AS VARCHAR) AS surface, list_max([CAST(x AS DOUBLE) FOR x IN embedding]) > 0.2 AS "high", v.name AS region FROM embeddings e, v""")
def e17_build_facts(spark, sf_dir):
    surfaces = S.bank(spark, sf_dir).select(F.col("vec_id").alias("frame_id"), F.col("label").alias("surface_id"))
    base = B.build_facts(_detections(spark, sf_dir), surfaces, (8, 8), S.nodes(spark, sf_dir), S.edges(spark, sf_dir), ["nation->IN_REGION.name"])
    out = B.wide(base, ["detection.image_level_score"], ["surface.id", "graph.nation.IN_REGION.name"])
    return out.select("frame_id", F.col("`surface.id`").alias("surface"), (F.col("`detection.image_level_score`") > 0.2).alias("high"), F.col("`graph.nation.IN_REGION.name`").alias("region"))


@query("SELECT event_id AS frame_id, CASE WHEN event_id % 3 = 0 THEN round(value * 2, 6) ELSE round(value, 6) END AS score, CASE WHEN event_id % 5 = 0 THEN event_type ELSE 'none' END AS kind, CASE WHEN event_id % 3 = 0 THEN 'Computed' ELSE 'Direct' END AS source FROM events")
def e15_fact_base(spark, sf_dir):
    """Set, overwritten for every third frame; a default where there is none."""
    e = S.table(spark, sf_dir, "events")
    fact = lambda rows, key, number, text, source: rows.select(F.col("event_id").alias("frame_id"), F.lit(key).alias("key"), number.cast("double").alias("number"), text.cast("string").alias("text"), F.lit(source).alias("source"))
    base = fact(e, "score", F.col("value"), F.lit(None), "Direct").unionByName(fact(e.filter("event_id % 5 = 0"), "kind", F.lit(None), F.col("event_type"), "Direct"))
    base = B.set_defaults(B.set_facts(base, fact(e.filter("event_id % 3 = 0"), "score", F.col("value") * 2, F.lit(None), "Computed")), {"kind": "none"})
    out = B.wide(base, ["score"], ["kind"]).join(B.get(base, "score").select("frame_id", "source"), "frame_id")
    return out.select("frame_id", F.round("score", 6).alias("score"), "kind", "source")


@query("""WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n, count(*) OVER (PARTITION BY label) AS size FROM embeddings), framed AS (
  SELECT label, vec_id, n // 8 AS frame, n % 8 AS patch, size // 8 AS frames FROM numbered
) SELECT label, vec_id FROM framed WHERE frames >= 6 AND frame < 6 AND patch % 2 = 0""")
def v18_bootstrap(spark, sf_dir):
    """Eight vectors of a label in a row are a frame, a rest of fewer is none; six frames start a bank. The target is what the sample has, so the coreset takes all."""
    n = _numbered(spark, sf_dir)
    sizes = n.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    patches = n.join(sizes, "label").filter("n < size - size % 8").select("label", "vec_id", "embedding", F.floor(F.col("n") / 8).alias("frame_id"), (F.col("n") % 8).alias("patch"))
    return T.bootstrapped(patches, "label", 6, 24).select("label", "vec_id")


@query("SELECT CAST(value / 500 AS DOUBLE) AS detection_score, event_type AS machine_verdict, CAST(user_id AS VARCHAR) AS surface_id, epoch_us(ts) AS timestamp FROM events")
def p11_inspection_records(spark, sf_dir):
    found = S.table(spark, sf_dir, "events")
    return R.ground_truth(found.select((F.col("value") / 500).alias("detection_score"), F.col("event_type").alias("machine_verdict"), F.col("user_id").alias("surface_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("timestamp")))
