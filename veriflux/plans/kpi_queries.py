"""Queries of quality indicators, tuning, queues, windows; and the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kpi as Q
from ..operators import knn as K
from ..operators import reasoner as T
from ..operators import rules as E
from ..session import shared_folder
from ..sources import tables
from ..streaming import windows as W
from . import frames as S
from .registry import query
from .retrieval_queries import nearest_sql
from .rule_queries import ALL, reasoned

COUNTS = "count(*) AS total, count(*) FILTER (verdict = 'OK') AS ok, count(*) FILTER (verdict = 'NG') AS ng, count(*) FILTER (verdict = 'WARN') AS warn, count(*) FILTER (verdict = 'UNCERTAIN') AS uncertain, round(1e6 * count(*) FILTER (verdict <> 'OK') / count(*), 4) AS ppm"


@query(ALL + f"SELECT position_id, {COUNTS} FROM reasoned GROUP BY 1")
def k1_ppm(spark, sf_dir):
    return Q.ppm(reasoned(spark, sf_dir), "position_id")


@query(ALL + """, l AS (SELECT * FROM reasoned ORDER BY frame_id DESC LIMIT 1000), c AS (SELECT frame_id, count(*) FILTER (verdict = 'NG') OVER w AS ng, count(*) FILTER (verdict = 'OK') OVER w AS ok FROM l WINDOW w AS (ORDER BY frame_id ROWS UNBOUNDED PRECEDING))
SELECT frame_id, round(coalesce(1e6 * (CAST(ng AS DOUBLE) / nullif(ng + ok, 0)), 0), 4) AS ppm FROM c""")
def k2_ppm_trend(spark, sf_dir):
    return Q.ppm_trend(reasoned(spark, sf_dir), "frame_id")


@query(ALL + """, t AS (SELECT unnest([CASE WHEN m_high THEN 'high_score' END, CASE WHEN r_mid THEN 'mid_score' END, CASE WHEN r_noisy THEN 'noisy' END, CASE WHEN m_late THEN 'late_view' END, CASE WHEN r_odd THEN 'odd_purchase' END]) AS defect FROM reasoned)
SELECT defect, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM reasoned), 6) AS percent FROM t WHERE defect IS NOT NULL GROUP BY 1""")
def k3_defect_share(spark, sf_dir):
    return Q.defect_share(reasoned(spark, sf_dir))


def _expected(spark, sf_dir):
    return reasoned(spark, sf_dir).withColumn("expected", F.when(F.col("event_type") == "error", "NG").otherwise("OK"))


@query(ALL + """, c AS (SELECT count(*) FILTER (verdict = 'OK' AND event_type <> 'error') AS tp, count(*) FILTER (verdict = 'NG' AND event_type = 'error') AS tn, count(*) FILTER (verdict = 'OK' AND event_type = 'error') AS fp, count(*) FILTER (verdict = 'NG' AND event_type <> 'error') AS fn FROM reasoned)
SELECT tp, tn, fp, fn, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall, round(2.0 * (tp / CAST(tp + fp AS DOUBLE)) * (tp / CAST(tp + fn AS DOUBLE)) / (tp / CAST(tp + fp AS DOUBLE) + tp / CAST(tp + fn AS DOUBLE)), 6) AS f1, round((tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE), 6) AS accuracy FROM c""")
def k4_confusion(spark, sf_dir):
    return Q.confusion(_expected(spark, sf_dir))


@query(ALL + "SELECT surface_id, arg_max(verdict, CASE verdict WHEN 'NG' THEN 3 WHEN 'WARN' THEN 2 WHEN 'UNCERTAIN' THEN 1 ELSE 0 END) AS worst, count(*) AS frames FROM reasoned GROUP BY 1")
def k5_worst_verdict(spark, sf_dir):
    return Q.worst_verdict(reasoned(spark, sf_dir))


@query("WITH w AS (SELECT event_id, event_type, value, list_sort(list(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)) AS r FROM events) SELECT event_id, r[1 + least(CAST(floor(0.99 * len(r) + 1e-9) AS INTEGER), len(r) - 1)] AS p99, value AS last FROM w")
def k6_latency_p99(spark, sf_dir):
    return Q.latency(S.table(spark, sf_dir, "events"), "event_type", "event_id", "value").select("event_id", "p99", "last")


@query(ALL + "SELECT frame_id, CASE WHEN severity > 0.7 THEN 'HIGH' WHEN severity > 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS bucket FROM reasoned")
def k7_severity_bucket(spark, sf_dir):
    return reasoned(spark, sf_dir).select("frame_id", Q.severity_bucket(F.col("severity")).alias("bucket"))


@query("""WITH h AS (SELECT date_trunc('day', ts) AS ts, count(*) AS n FROM events GROUP BY 1), c AS (SELECT ts, sum(n) OVER (ORDER BY ts) AS done FROM h)
SELECT strftime(ts, '%Y-%m-%d') AS day, round((done - lag(done) OVER (ORDER BY ts)) / (epoch(ts) - lag(epoch(ts)) OVER (ORDER BY ts)), 9) AS fps FROM c""")
def k8_throughput(spark, sf_dir):
    from pyspark.sql import Window

    h = S.table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    c = h.withColumn("done", F.sum("n").over(Window.orderBy("ts")))  # a row for each day
    return Q.throughput(c, "ts", "done").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.round("fps", 9).alias("fps"))


def _truth(spark, sf_dir):
    f = S.frames(spark, sf_dir)
    return f.select(F.when(F.col("frame_id") % 10 != 0, F.col("score")).alias("score"), (F.col("k") > 50).alias("stored_ng"), (F.col("event_type") == "error").alias("is_ng"))


TRUTH = f"WITH {S.FRAMES_SQL}, g AS (SELECT CASE WHEN frame_id % 10 <> 0 THEN score END AS score, k > 50 AS stored_ng, event_type = 'error' AS is_ng FROM frames)"


@query(TRUTH + ", c AS (SELECT count(*) AS total, count(*) FILTER (stored_ng AND NOT is_ng) AS fp, count(*) FILTER (NOT stored_ng AND is_ng) AS fn FROM g) SELECT *, round((1.0 * fp + 5.0 * fn) / total, 6) AS cost FROM c")
def a1_cost(spark, sf_dir):
    return Q.confusion_cost(_truth(spark, sf_dir).withColumn("machine_ng", F.col("stored_ng")))


@query(TRUTH + """, t AS (SELECT i / 100.0 AS threshold FROM range(1, 100) r(i)), c AS (
  SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (ng AND NOT is_ng) AS fp, count(*) FILTER (NOT ng AND is_ng) AS fn, count(*) AS total
  FROM (SELECT t.threshold, g.*, CASE WHEN score IS NOT NULL THEN score > t.threshold ELSE stored_ng END AS ng FROM g, t) GROUP BY 1
) SELECT *, round((1.0 * fp + 5.0 * fn) / total, 6) AS cost FROM c""")
def a2_threshold_replay(spark, sf_dir):
    return Q.threshold_replay(_truth(spark, sf_dir), [i / 100 for i in range(1, 100)])


@query(ALL + ", c AS (SELECT count(*) AS samples, count(*) FILTER (verdict = 'NG') / CAST(count(*) AS DOUBLE) AS r FROM reasoned) SELECT samples, round(r, 6) AS ng_rate, samples >= 50 AND NOT (r BETWEEN 0.001 AND 0.5) AS rollback FROM c")
def a8_circuit_breaker(spark, sf_dir):
    return Q.circuit_breaker(reasoned(spark, sf_dir)).withColumn("ng_rate", F.round("ng_rate", 6))


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 4")
def p4_drop_oldest(spark, sf_dir):
    return Q.drop_oldest(S.table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 4).select("event_id", "user_id")


@query(ALL + "SELECT surface_id, frame_id, verdict, position_id, count(*) OVER (PARTITION BY surface_id) AS total_frames FROM reasoned")
def s13_review_index(spark, sf_dir):
    """The index as files of a few folders, read again."""
    folder = shared_folder(spark, "review")
    tables.write_review_index(reasoned(spark, sf_dir), folder)
    out = spark.read.schema("surface_id long, frame_id long, verdict string, position_id long").json(folder).drop("part")
    sizes = out.groupBy(F.col("surface_id").alias("own")).agg(F.count(F.lit(1)).alias("total_frames"))
    return out.join(sizes, F.col("surface_id").eqNullSafe(F.col("own"))).drop("own")


@query(ALL + "SELECT surface_id, count(*) AS total_frames, min(frame_id) AS first, arg_min(verdict, frame_id) AS first_verdict FROM reasoned GROUP BY 1")
def s13_review_rows(spark, sf_dir):
    out = tables.review_index(reasoned(spark, sf_dir))
    first = F.get(F.from_json("frames", "array<struct<frame_id long, verdict string>>"), F.lit(0))
    return out.select("surface_id", "total_frames", first["frame_id"].alias("first"), first["verdict"].alias("first_verdict"))


@query(ALL + "SELECT frame_id, verdict FROM reasoned WHERE verdict <> 'OK' ORDER BY frame_id DESC LIMIT 20")
def s16_latest_alerts(spark, sf_dir):
    return reasoned(spark, sf_dir).filter("verdict <> 'OK'").orderBy(F.desc("frame_id")).limit(20).select("frame_id", "verdict")


def _events(spark, sf_dir):
    return S.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_type, epoch_us(date_trunc('day', ts)) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def x_tumbling(spark, sf_dir):
    return W.tumbling(_events(spark, sf_dir), "1 day", "event_type").withColumn("start", F.unix_micros("start"))


@query("SELECT epoch_us(time_bucket(INTERVAL 6 HOURS, ts) - INTERVAL 6 HOURS * o) AS start, count(*) AS n FROM events, range(2) r(o) GROUP BY 1")
def x_sliding(spark, sf_dir):
    return W.sliding(_events(spark, sf_dir), "12 hours", "6 hours").withColumn("start", F.unix_micros("start"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 4 HOURS THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def x_session(spark, sf_dir):
    return W.sessions(_events(spark, sf_dir), "4 hours", "user_id").withColumn("start", F.unix_micros("start"))


FLAG_RULES = """
rule_sets:
  distance:
    - {name: far, condition: {field: score, op: ">", value: 0.6}, action: {label: far, base_severity: 0.9}, overrides: [offset]}
    - {name: offset, condition: {field: score, op: ">", value: 0.5}, action: {label: offset, base_severity: 0.4}}
"""
FLAG_TREE = """
type: branch
field: score
branches:
  ">0.55": {type: leaf, label: distant, formulas: [{weights: [10.0], features: [score], threshold: 5.5}]}
default: {type: leaf, label: OK}
"""


@query(f"""WITH {nearest_sql(1, of='TRUE')}, f AS (SELECT e.label, round(f.d2, 6) / 2 AS score FROM found f JOIN embeddings e ON e.vec_id = f.query_id), v AS (
  SELECT label, CASE WHEN score > 0.55 THEN CASE WHEN 1 / (1 + exp(-(10.0 * score - 5.5))) > 0.7 THEN 'NG' WHEN 1 / (1 + exp(-(10.0 * score - 5.5))) > 0.3 THEN 'WARN' ELSE 'OK' END ELSE 'OK' END AS verdict,
    score > 0.6 AS far, score > 0.5 AND NOT score > 0.6 AS near_far FROM f
) SELECT label, {COUNTS}, count(*) FILTER (far) AS far, count(*) FILTER (near_far) AS "offset" FROM v GROUP BY 1""")
def entry(spark, sf_dir):
    """From embeddings to verdicts: the nearest neighbour's distance of each vector, rules, tree, counts by label."""
    bank = S.bank(spark, sf_dir)
    near = K.knn(bank.select("vec_id", "embedding"), bank, 1, exclude_self=True)
    f = near.select(F.col("query_id").alias("vec_id"), (F.round("d2", 6) / 2).alias("score")).join(bank.select("vec_id", "label"), "vec_id")
    node, mapping = T.load_tree(FLAG_TREE)
    out = T.reason(E.evaluate(f, E.load_rules(FLAG_RULES)), node, mapping)
    hit = lambda i: F.count_if(F.get("resolved", F.lit(i))["matched"])
    extra = out.groupBy("label").agg(hit(0).alias("far"), hit(1).alias("offset"))
    return Q.ppm(out, "label").join(extra, "label")
