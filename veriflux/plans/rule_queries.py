"""Queries of rules and reasoning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reasoner as T
from ..operators import rules as E
from ..sources import tables
from . import frames as S
from .registry import query
from .topology import load_topology, run_tasks, run_topology, stage_metrics

LONG = """SELECT frame_id, unnest(['high_score', 'mid_score', 'noisy', 'late_view', 'missing_fact', 'odd_purchase']) AS rule, unnest([{}]) AS matched FROM {}"""


def _rows(df):
    return df.select("frame_id", F.explode("resolved").alias("r")).select("frame_id", "r.rule", "r.matched")


@query(f"WITH {S.FRAMES_SQL}, {S.RAW_SQL} {LONG.format('m_high, m_mid, m_noisy, m_late, FALSE, m_odd', 'raw')}")
def e11_rule_matches(spark, sf_dir):
    return _rows(E.evaluate(S.frames(spark, sf_dir), S.rules(), resolve=False))


@query(f"WITH {S.FRAMES_SQL}, {S.RAW_SQL} {LONG.format('m_high, m_mid AND NOT m_high, m_noisy AND NOT m_mid, m_late, FALSE, m_odd AND NOT m_noisy', 'raw')}")
def e13_conflicts(spark, sf_dir):
    return _rows(E.evaluate(S.frames(spark, sf_dir), S.rules()))


@query("SELECT * FROM (VALUES ('defects', 'high_score', 'mid_score', 'score'), ('process', 'missing_fact', 'odd_purchase', 'score'), ('process', 'late_view', 'odd_purchase', 'event_type')) t(rule_set, rule, other, fields)")
def e14_overlaps(spark, sf_dir):
    return spark.createDataFrame([(s, a, b, ",".join(f)) for s, a, b, f in E.overlaps(S.rules())], "rule_set string, rule string, other string, fields string")


@query(f"WITH {S.FRAMES_SQL}, {S.RAW_SQL} SELECT frame_id, m_high OR m_mid OR m_noisy OR m_odd AS ng FROM (SELECT frame_id, m_high, m_mid AND NOT m_high AS m_mid, m_noisy AND NOT m_mid AS m_noisy, m_odd AND NOT m_noisy AS m_odd FROM raw)")
def e18_rule_verdict(spark, sf_dir):
    out = E.evaluate(S.frames(spark, sf_dir), S.rules())
    return out.select("frame_id", F.exists("resolved", lambda r: r["matched"] & (r["severity"] > 0)).alias("ng"))


@query(f"WITH {S.FRAMES_SQL} SELECT frame_id, round(score + k, 6) AS added, round(score / nullif(k, 0), 12) AS divided, event_type <= event_type AS text_le, FALSE AS text_lt, FALSE AS mixed_eq, k IN (1, 2, 3) AS listed, TRUE AS not_less FROM frames")
def e3_operators(spark, sf_dir):
    f = S.frames(spark, sf_dir)
    t = dict(f.dtypes)
    ref = lambda n: E.field_ref(n, t)
    c = {"added": F.round(E.binary("add", ref("score"), ref("k")).col, 6), "divided": F.round(E.binary("div", ref("score"), ref("k")).col, 12), "text_le": E.binary("le", ref("event_type"), ref("event_type")).col, "text_lt": E.binary("lt", ref("event_type"), ref("event_type")).col}
    c |= {"mixed_eq": E.binary("eq", ref("k"), ref("event_type")).col, "listed": E.binary("in", ref("k"), E._const([1.0, 2.0, 3.0])).col, "not_less": E.unary("not", E.binary("lt", ref("event_type"), ref("event_type"))).col}
    return f.select("frame_id", *[v.alias(k) for k, v in c.items()])


VALUES = [("true = 1", "==", True, 1.0), ("null = null", "==", None, None), ("1 = 1", "==", 1.0, 1.0), ("text <= same", "<=", "a", "a"), ("text < other", "<", "a", "b"), ("2 >= 1", ">=", 2.0, 1.0), ("1 != text", "!=", 1.0, "1")]


@query("SELECT * FROM (VALUES ('true = 1', FALSE), ('null = null', TRUE), ('1 = 1', TRUE), ('text <= same', TRUE), ('text < other', FALSE), ('2 >= 1', TRUE), ('1 != text', TRUE)) t(what, result)")
def e7_value_semantics(spark, sf_dir):
    rows = F.array(*[F.struct(F.lit(n).alias("what"), E.binary(E.OPS[op], E._const(a), E._const(b)).col.alias("result")) for n, op, a, b in VALUES])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


@query(f"WITH {S.FRAMES_SQL} SELECT frame_id, round(greatest(score, k / 100), 6) AS largest, round((score + k) / 2, 6) AS mean, CAST(octet_length(encode(event_type)) AS DOUBLE) AS bytes FROM frames")
def e5_functions(spark, sf_dir):
    f = S.frames(spark, sf_dir)
    t = dict(f.dtypes)
    score, k = E.field_ref("score", t), E.field_ref("k", t)
    return f.select("frame_id", F.round(E.function("max", [score, E.binary("div", k, E._const(100))]).col, 6).alias("largest"), F.round(E.function("avg", [score, k]).col, 6).alias("mean"), E.function("len", [E.field_ref("event_type", t)]).col.alias("bytes"))


def reasoned(spark, sf_dir):
    node, mapping = S.tree()
    return T.reason(E.evaluate(S.frames(spark, sf_dir), S.rules()), node, mapping)


ALL = f"WITH {S.FRAMES_SQL}, {S.RAW_SQL}, {S.REASONED_SQL} "


@query(ALL + "SELECT frame_id, verdict, recommendation FROM reasoned")
def t2_tree_verdict(spark, sf_dir):
    return reasoned(spark, sf_dir).select("frame_id", "verdict", "recommendation")


@query(ALL + "SELECT frame_id, severity FROM reasoned")
def t5_leaf_score(spark, sf_dir):
    return reasoned(spark, sf_dir).select("frame_id", "severity")


@query(ALL + """SELECT frame_id, surface_id, position_id, verdict, severity, recommendation,
  array_to_string([x FOR x IN [CASE WHEN m_high THEN 'high_score' END, CASE WHEN r_mid THEN 'mid_score' END, CASE WHEN r_noisy THEN 'noisy' END, CASE WHEN m_late THEN 'late_view' END, CASE WHEN r_odd THEN 'odd_purchase' END] IF x IS NOT NULL], ',') AS triggered FROM reasoned""")
def t7_reason_result(spark, sf_dir):
    out = reasoned(spark, sf_dir)
    return out.select("frame_id", "surface_id", "position_id", "verdict", "severity", "recommendation", F.array_join("triggered", ",").alias("triggered"))


@query(f"WITH {S.FRAMES_SQL}, {S.RAW_SQL}, l AS ({LONG.format('m_high, m_mid AND NOT m_high, m_noisy AND NOT m_mid, m_late, FALSE, m_odd AND NOT m_noisy', 'raw')}) SELECT frame_id, 'rule' AS kind, rule AS name, CASE WHEN matched THEN 'true' ELSE 'false' END AS value FROM l UNION ALL SELECT frame_id, 'fact', 'event_type', event_type FROM frames UNION ALL SELECT frame_id, 'fact', 'surface_id', CAST(surface_id AS VARCHAR) FROM frames")
def t9_evidence(spark, sf_dir):
    return T.evidence(reasoned(spark, sf_dir), ["surface_id", "event_type"]).drop("step")


BRANCH = "CASE WHEN event_type = 'error' THEN CASE WHEN score <= 0.2 THEN '/event_type=error/score=<=0.2' WHEN score > 0.9 THEN '/event_type=error/score=>0.9' ELSE '/event_type=error/score=default' END WHEN event_type = 'purchase' THEN '/event_type=purchase' ELSE '/event_type=default' END"


@query(ALL + f"SELECT frame_id, CAST(unnest(range(8)) AS INTEGER) AS step, unnest(['rule:high_score', 'rule:mid_score', 'rule:noisy', 'rule:late_view', 'rule:missing_fact', 'rule:odd_purchase', 'branch' || {BRANCH}, 'score']) AS what, unnest([0.0::DOUBLE, 0, 0, 0, 0, 0, 0, severity]) AS value FROM reasoned")
def t8_trace(spark, sf_dir):
    """The steps of each verdict in order: rules, the tree's branch, the score."""
    step = lambda what, value: F.struct(what.alias("what"), value.cast("double").alias("value"))
    steps = F.concat(F.transform("resolved", lambda r: step(F.concat_ws(":", F.lit("rule"), r["rule"]), F.lit(0))), F.array(step(F.concat(F.lit("branch"), "path"), F.lit(0)), step(F.lit("score"), F.col("severity"))))
    return reasoned(spark, sf_dir).select("frame_id", F.posexplode(steps).alias("step", "s")).select("frame_id", "step", "s.what", "s.value")


@query(ALL + """SELECT frame_id, 'default' AS sku_id, 'pos_' || position_id AS serial_number, verdict,
  array_to_string([x FOR x IN [CASE WHEN m_high THEN 'high_score' END, CASE WHEN r_mid THEN 'mid_score' END, CASE WHEN r_noisy THEN 'noisy' END, CASE WHEN m_late THEN 'late_view' END, CASE WHEN r_odd THEN 'odd_purchase' END] IF x IS NOT NULL], ',') AS defects FROM reasoned""")
def s10_reports(spark, sf_dir):
    """The reports as JSON, read again."""
    kind = "sku_id string, serial_number string, verdict string, defects array<struct<label string, severity string, confidence double>>"
    out = tables.reports(reasoned(spark, sf_dir)).select("frame_id", F.from_json("report", kind).alias("r"))
    return out.select("frame_id", "r.sku_id", "r.serial_number", "r.verdict", F.array_join("r.defects.label", ",").alias("defects"))


TOPOLOGY = """
pipeline:
  name: inspection
  version: "1.0"
  stages:
    - {id: frames, type: Capture}
    - {id: clean, type: Preprocess, depends_on: [frames]}
    - {id: embed, type: Inference, depends_on: [clean]}
    - {id: detect, type: Detect, depends_on: [embed], config: {over: 0.25}}
    - {id: rules, type: RuleEval, depends_on: [detect]}
    - {id: verdicts, type: Reason, depends_on: [rules]}
    - {id: out, type: Export, depends_on: [verdicts]}
"""


@query(ALL + "SELECT frame_id, verdict FROM reasoned WHERE score > 0.25")
def p1_topology(spark, sf_dir):
    node, mapping = S.tree()
    transforms = {
        "Detect": lambda df, config: df.filter(F.col("score") > config["over"]),
        "RuleEval": lambda df, config: E.evaluate(df, S.rules()),
        "Reason": lambda df, config: T.reason(df, node, mapping),
        "Export": lambda df, config: df.select("frame_id", "verdict"),
    }
    return run_topology(load_topology(TOPOLOGY), S.frames(spark, sf_dir), transforms)


@query(ALL + "SELECT 'frames' AS stage, count(*) AS taken, count(*) AS processed, 0 AS dropped FROM reasoned UNION ALL SELECT s, (SELECT count(*) FROM reasoned), (SELECT count(*) FROM reasoned), 0 FROM (VALUES ('clean'), ('embed')) t(s) UNION ALL SELECT 'detect', count(*), count(*) FILTER (score > 0.25), count(*) FILTER (NOT score > 0.25) FROM reasoned UNION ALL SELECT s, (SELECT count(*) FILTER (score > 0.25) FROM reasoned), (SELECT count(*) FILTER (score > 0.25) FROM reasoned), 0 FROM (VALUES ('rules'), ('verdicts'), ('out')) t(s)")
def p8_stage_metrics(spark, sf_dir):
    node, mapping = S.tree()
    transforms = {"Detect": lambda df, config: df.filter(F.col("score") > config["over"]), "RuleEval": lambda df, config: E.evaluate(df, S.rules()), "Reason": lambda df, config: T.reason(df, node, mapping)}
    return stage_metrics(load_topology(TOPOLOGY), S.frames(spark, sf_dir), transforms)


@query("SELECT * FROM (VALUES ('all', 'done', 10), ('bad', 'failed', NULL), ('half', 'done', 5), ('after', 'skipped', NULL), ('later', 'skipped', NULL)) t(task, status, result)")
def p13_task_graph(spark, sf_dir):
    """Tasks after those they depend on, each once; what depends on a failed one is skipped."""
    done = run_tasks({"all": ((), lambda: 10), "half": (("all",), lambda n: n // 2), "bad": (("half",), lambda n: n // 0), "after": (("bad", "all"), lambda a, b: b), "later": (("after",), lambda a: a)})
    return spark.createDataFrame([(n, s, r if s == "done" else None) for n, (s, r) in done.items()], "task string, status string, result int")


LITERALS = [("true", "bool"), ("False", "bool"), ("3.5", "number"), ("-2", "number"), ("12", "number"), ("abc", "string"), ("1.2.3", "string"), ("", "string")]


@query("SELECT * FROM (VALUES ('true', 'bool', 1.0::DOUBLE), ('False', 'bool', 0.0), ('3.5', 'number', 3.5), ('-2', 'number', -2.0), ('12', 'number', 12.0), ('abc', 'string', NULL), ('1.2.3', 'string', NULL), ('', 'string', NULL)) t(text, kind, number)")
def e2_literals(spark, sf_dir):
    rows = []
    for text, _ in LITERALS:
        v = E.literal(text)
        rows.append((text, "bool" if isinstance(v, bool) else "number" if isinstance(v, float) else "string", None if isinstance(v, str) else float(v)))
    return spark.createDataFrame(rows, "text string, kind string, number double")
