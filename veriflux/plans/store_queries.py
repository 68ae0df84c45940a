"""Queries of the graph store, of files that are written and read again, of buffers, rebuilds and tuning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import kpi as Q
from ..operators import reasoner as T
from ..operators import rules as E
from ..operators import stats as V
from ..operators import tuning as A
from ..session import shared_folder
from ..sources import images, models, tables
from ..streaming import evolution as M
from . import frames as S
from .detector_queries import _banks, _model
from .registry import query
from .rule_queries import ALL
from .stat_queries import PROFILE_SQL, _kth, _maps

FIRST = "ins AS (SELECT row_number() OVER (ORDER BY r_regionkey) AS id, r_name FROM region)"


def _store(spark, sf_dir):
    """Regions as nodes, two edges; then changes of each kind."""
    rows = S.table(spark, sf_dir, "region").orderBy("r_regionkey").select(F.to_json(F.struct(F.col("r_name").alias("name"))).alias("p")).collect()  # five
    store = G.GraphStore(spark)
    ids = store.insert_nodes([("region", r.p) for r in rows])
    store.insert_edge(ids[0], ids[1], "NEXT")
    store.insert_edge(ids[1], ids[2], "NEXT")
    store.update_node(ids[1], '{"name": "changed"}', by="me")
    store.set_field(ids[2], "mark", 7, by="system")
    store.delete_node(ids[4])
    store.delete_node(999)
    store.delete_edge(1)
    return store


@query(f"""WITH {FIRST} SELECT id AS entry_id, 'node' AS entity_type, id AS entity_id, 'Insert' AS op, CAST(1 AS INTEGER) AS version, 'system' AS changed_by FROM ins
UNION ALL SELECT * FROM (VALUES (6, 'edge', 1, 'Insert', 1, 'system'), (7, 'edge', 2, 'Insert', 1, 'system'), (8, 'node', 2, 'Update', 2, 'me'), (9, 'node', 3, 'Update', 2, 'system'), (10, 'node', 5, 'Delete', 2, 'system'), (11, 'edge', 1, 'Delete', 2, 'system')) t""")
def g14_store_log(spark, sf_dir):
    return _store(spark, sf_dir).log.select("entry_id", "entity_type", "entity_id", "op", "version", "changed_by")


@query(f"WITH {FIRST} SELECT id, CASE WHEN id = 2 THEN 'changed' ELSE r_name END AS name, CASE WHEN id = 3 THEN 7::BIGINT END AS mark, CASE WHEN id = 2 THEN 1::BIGINT ELSE 0::BIGINT END AS edges_out FROM ins WHERE id <> 5")
def g1_store_nodes(spark, sf_dir):
    """What is left of the nodes after inserts, an update, a field and deletions, and their edges."""
    store = _store(spark, sf_dir)
    one = store.get_edge(2)
    out = store.find_by_type("region").select("id", F.get_json_object("properties", "$.name").alias("name"), F.get_json_object("properties", "$.mark").cast("long").alias("mark"))
    return out.withColumn("edges_out", F.when((F.col("id") == one.source_id) & F.lit(store.get_node(2).type == "region"), 1).otherwise(0).cast("long"))


@query("SELECT * FROM (VALUES ('first', 5::BIGINT, 1::BIGINT, TRUE), ('second', 4::BIGINT, 1::BIGINT, FALSE)) t(name, node_count, edge_count, restored)")
def g15_snapshots(spark, sf_dir):
    """Made, listed, restored and deleted; they are folders."""
    rows = S.table(spark, sf_dir, "region").count()
    store = G.GraphStore(spark, audit=False)
    ids = store.insert_nodes([("region", "{}")] * rows)
    store.insert_edge(ids[0], ids[1], "NEXT")
    store.snapshot("first")
    store.delete_node(ids[0])
    store.snapshot("second")
    store.snapshot("third")
    store.delete_snapshot("third")
    store.restore("first")
    back = store.nodes.count() == rows
    return store.list_snapshots().select("name", "node_count", "edge_count", (F.lit(back) & (F.col("name") == "first")).alias("restored"))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n FROM embeddings), b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r FROM n WHERE n % 2 = 1)
SELECT CAST(label % 3 AS VARCHAR) AS surface_id, CAST(label AS INTEGER) AS position_id, r AS row, round(list_sum([CAST(x AS DOUBLE) FOR x IN embedding]), 6) AS total FROM b""")
def s7_bank_files(spark, sf_dir):
    """Raw float32 files and their manifests, written and read again."""
    folder = tables.write_bank_files(_banks(spark, sf_dir), shared_folder(spark, "banks"))
    found = tables.read_banks(spark, tables.read_bank_manifest(spark, folder), 64)
    return found.select("surface_id", "position_id", "row", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


def _put(folder: str, files: dict[str, bytes]) -> str:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    for name, content in files.items():
        with store.open_output_stream(f"{path}/{name}") as out:
            out.write(content)
    return folder


@query("SELECT r_name AS surface_id, 'img_' || n_nationkey || '.png' AS file, CAST(n_nationkey % 4 AS INTEGER) AS position_id, CAST(1 AS INTEGER) AS light_id, CASE WHEN n_nationkey % 2 = 0 THEN 'OK' END AS expected FROM nation JOIN region ON n_regionkey = r_regionkey")
def s1_manifests(spark, sf_dir):
    import yaml

    rows = S.table(spark, sf_dir, "nation").join(S.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_nationkey").collect()  # 25
    docs: dict = {}
    for r in rows:
        entry = {"path": f"img_{r.n_nationkey}.png", "position": r.n_nationkey % 4, "light": 1} | ({"expected": "OK"} if r.n_nationkey % 2 == 0 else {})
        docs.setdefault(r.r_name, {"surface": r.r_name, "images": []})["images"].append(entry)
    folder = _put(shared_folder(spark, "manifests"), {f"{i}.yaml": yaml.safe_dump(d).encode() for i, d in enumerate(docs.values())})
    return tables.read_manifest(spark, folder).select("surface_id", F.element_at(F.split("path", "/"), -1).alias("file"), "position_id", "light_id", "expected")


@query("WITH f AS (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings), p AS (SELECT label, [CAST(floor((CAST(x AS DOUBLE) + 1) * 127.5) AS BIGINT) FOR x IN embedding] AS p FROM f WHERE n = 1) SELECT label || '.ppm' AS file, CAST(8 AS INTEGER) AS height, CAST(8 AS INTEGER) AS width, list_sum(p)::BIGINT AS total FROM p")
def s4_image_folder(spark, sf_dir):
    """Pictures in a folder with other files: listed by suffix, and decoded."""
    rows = S.bank(spark, sf_dir).groupBy("label").agg(F.min_by("embedding", "vec_id").alias("e")).collect()  # a row a label
    pictures = {f"{r.label}.ppm": b"P5 8 8 255\n" + np.floor((np.array(r.e, float) + 1) * 127.5).astype(np.uint8).tobytes() for r in rows}
    folder = _put(shared_folder(spark, "pictures"), pictures | {"notes.txt": b"no picture", "x.tif": b""})
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    found = images.read_images(spark, f"{folder}/*.ppm")
    pixels = F.aggregate(F.transform(F.sequence(F.lit(1), F.length("pixels")), lambda i: F.ascii(F.decode(F.substring("pixels", i, F.lit(1)), "ISO-8859-1"))), F.lit(0).cast("long"), lambda a, x: a + x)
    listed = tables.scan_images(spark, folder).select(name("path").alias("file"))
    return listed.join(found.select(name("path").alias("file"), "height", "width", pixels.alias("total")), "file")


@query("SELECT CAST(64 AS INTEGER) AS dim, CAST(2 AS INTEGER) AS components, 0.64::DOUBLE AS mean, 0.75::DOUBLE AS eigenvalues, 1.0::DOUBLE AS first_norm")
def s8_pca_file(spark, sf_dir):
    """A PCA model as a file, written and read again."""
    folder = _put(shared_folder(spark, "model"), {"model.pca": models.pca_bytes(_model())})
    content = spark.read.format("binaryFile").load(folder).first().content
    p = models.pca_from_bytes(bytes(content))
    return spark.createDataFrame([(p.components.shape[1], p.components.shape[0], round(float(p.mean.sum()), 6), round(float(p.eigenvalues.sum()), 6), round(float((p.components[0] ** 2).sum()), 6))], "dim int, components int, mean double, eigenvalues double, first_norm double")


@query(f"WITH {PROFILE_SQL} SELECT CAST(2 AS BIGINT) AS k_nearest, CAST(64 AS BIGINT) AS dim, (SELECT count(*) FROM embeddings) AS num_samples, round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99, 6) AS p99, round(mean, 6) AS mean, round(stddev, 6) AS stddev FROM p")
def s9_profile_file(spark, sf_dir):
    own = V.normality_profile(_kth(spark, sf_dir)).first().asDict()
    text = models.profile_yaml(own | {"k_nearest": 2, "dim": 64, "num_samples": S.bank(spark, sf_dir).count()})
    folder = _put(shared_folder(spark, "profile"), {"profile.yaml": text.encode()})
    p = models.profile_from_yaml(bytes(spark.read.format("binaryFile").load(folder).first().content).decode())
    names = ("p50", "p95", "p99", "mean", "stddev")
    return spark.createDataFrame([(p["k_nearest"], p["dim"], p["num_samples"], *[round(p[n], 6) for n in names])], "k_nearest long, dim long, num_samples long, " + ", ".join(f"{n} double" for n in names))


@query("SELECT vec_id AS frame_id, CAST(13 + 16 * 16 * 3 AS BIGINT) AS n_bytes, TRUE AS red_where_largest FROM embeddings")
def s12_heatmaps(spark, sf_dir):
    """Pictures of all grids as files, read again: their size, and the colour of the largest cell."""
    folder = shared_folder(spark, "heatmaps")
    maps = _maps(spark, sf_dir)
    models.write_heatmaps(maps, folder, (8, 8), (16, 16))
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"(\d+)\.ppm$", 1).cast("long").alias("frame_id"), "length", "content")
    at = F.array_position("scores", F.array_max("scores")).cast("int") - 1
    pixel = F.lit(13) + 3 * (F.floor(at / 8) * 2 * 16 + at % 8 * 2) + 1
    red = F.hex(F.substring("content", pixel.cast("int"), F.lit(3))) == "FF0000"
    return files.join(maps, "frame_id").select("frame_id", F.col("length").alias("n_bytes"), red.alias("red_where_largest"))


@query("""WITH s AS (SELECT date_trunc('day', ts) AS batch_id, user_id, count(*) AS n FROM events GROUP BY 1, 2), k AS (SELECT *, row_number() OVER w AS f, sum(n) OVER w AS p FROM s WINDOW w AS (ORDER BY batch_id, user_id ROWS UNBOUNDED PRECEDING))
SELECT event_id FROM events e JOIN k ON k.user_id = e.user_id AND k.batch_id = date_trunc('day', e.ts) WHERE f <= 300 AND p <= 400""")
def m8_buffer(spark, sf_dir):
    e = S.table(spark, sf_dir, "events").select(F.date_trunc("day", "ts").alias("batch_id"), F.col("user_id").alias("frame_id"), "event_id")
    return M.buffered(e, M.EvolutionConfig(max_frames=300, max_patches=400)).select("event_id")


@query("SELECT count(*) AS candidates, count(*) >= 100 OR count(DISTINCT user_id) >= 20 AS triggered FROM events WHERE event_type = 'click'")
def m8_trigger(spark, sf_dir):
    e = S.table(spark, sf_dir, "events").filter("event_type = 'click'").select(F.col("user_id").alias("frame_id"), "event_id")
    hit = M.triggered(e, M.EvolutionConfig(trigger_frames=20, trigger_patches=100))
    return e.agg(F.count(F.lit(1)).alias("candidates")).withColumn("triggered", F.lit(hit))


@query("SELECT CAST(60 AS BIGINT) AS vectors, TRUE AS moved, (SELECT count(*) FROM embeddings WHERE label < 5) AS backup")
def m12_rebuild(spark, sf_dir):
    bank = S.bank(spark, sf_dir)
    folder = shared_folder(spark, "rebuild")
    out = M.rebuild(bank.filter("label < 5"), bank.filter("label >= 5"), M.EvolutionConfig(target=60, normality_k=3), folder)
    kept = spark.read.parquet(f"{folder}/backup").count()
    return spark.createDataFrame([(out["vectors"], out["displacement"] > 0, kept)], "vectors long, moved boolean, backup long")


@query("SELECT TRUE AS accepted, (SELECT count(*) FROM embeddings WHERE label < 5) + 20 AS vectors")
def m10_update(spark, sf_dir):
    """Twenty of the candidates come in by the prefilter, and the version is checked against the old bank."""
    bank = S.bank(spark, sf_dir)
    version, new = M.update(bank.filter("label < 5"), bank.filter("label >= 5"), M.EvolutionConfig(prefilter=20))
    return spark.createDataFrame([(new, version.count())], "accepted boolean, vectors long")


EVOLUTION = """
self_evolution:
  enabled: true
  normality: {k_self_query: 7}
  buffer: {max_frames: 10, trigger_patches: 99}
  update: {target_size: 500}
  maintenance: {coverage_saturation_threshold: 0.9}
"""


@query("SELECT * FROM (VALUES ('enabled', 1.0::DOUBLE), ('normality_k', 7), ('tail_ratio_max', 0.1), ('max_frames', 10), ('max_patches', 50000), ('trigger_frames', 20), ('trigger_patches', 99), ('target', 500), ('prefilter', 5000), ('coverage_threshold', 0.6), ('saturation_coverage', 0.9), ('saturation_window', 10), ('least_coverage_share', 0.8)) t(name, value)")
def m14_config(spark, sf_dir):
    c = M.config_from_yaml(EVOLUTION)
    names = ("enabled", "normality_k", "tail_ratio_max", "max_frames", "max_patches", "trigger_frames", "trigger_patches", "target", "prefilter", "coverage_threshold", "saturation_coverage", "saturation_window", "least_coverage_share")
    return spark.createDataFrame([(n, float(getattr(c, n))) for n in names], "name string, value double")


SPACE = """
tuning:
  parameters:
    - {name: low, type: continuous, min: 0.0, max: 1.0}
    - {name: high, type: discrete, min: 0.5, max: 2.5, step: 0.5}
  constraints:
    - {lhs: low, rhs: high, coeff_lhs: 1.0, coeff_rhs: -1.0, bound: -0.25}
"""


@query("WITH p AS (SELECT i / 4.0::DOUBLE - 0.25 AS low, j / 4.0::DOUBLE AS high FROM range(7) a(i), range(12) b(j)) SELECT low, high, low BETWEEN 0 AND 1 AND high BETWEEN 0.5 AND 2.5 AND (high * 2) % 1 = 0 AND low - high <= -0.25 + 1e-9 AS feasible FROM p")
def a3_space(spark, sf_dir):
    space = A.load_space(SPACE)
    points = [(i / 4 - 0.25, j / 4) for i in range(7) for j in range(12)]
    return spark.createDataFrame([(a, b, bool(space.feasible([a, b]))) for a, b in points], "low double, high double, feasible boolean")


@query((ALL + "SELECT frame_id, verdict, severity FROM reasoned").replace("greatest(f1, f2)", "greatest(1 / (1 + exp(-(4.0 * score + 0.01 * k - 2.5))), f2)").replace("leaf_score > 0.7", "leaf_score > 0.6"))
def a9_write_back(spark, sf_dir):
    """A tree with a threshold and a verdict's bound put in by their addresses, and read again."""
    node, mapping = T.load_tree(A.write_back(S.TREE, {"leaf_0.formula_0.threshold": 2.5, "verdict_mapping.ng": 0.6}))
    return T.reason(E.evaluate(S.frames(spark, sf_dir), S.rules()), node, mapping).select("frame_id", "verdict", "severity")


@query("SELECT user_id % 7 AS stage, count(*) FILTER (event_type <> 'signup') AS processed, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'view') AS dropped, count(*) FILTER (event_type <> 'signup') - count(*) FILTER (event_type = 'error') - count(*) FILTER (event_type = 'view') AS in_flight FROM events GROUP BY 1")
def k8_in_flight(spark, sf_dir):
    e = S.table(spark, sf_dir, "events")
    kind = lambda c: F.count_if(c)
    rows = e.groupBy((F.col("user_id") % 7).alias("stage")).agg(kind(F.col("event_type") != "signup").alias("processed"), kind(F.col("event_type") == "error").alias("failed"), kind(F.col("event_type") == "view").alias("dropped"))
    return Q.in_flight(rows)
