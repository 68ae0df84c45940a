import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veriflux.functions.vectors import l2_normalised
from veriflux.operators import graph as G
from veriflux.operators import image as I
from veriflux.operators import knn as K
from veriflux.operators import kpi as Q
from veriflux.operators import linalg as L
from veriflux.operators import reasoner as T
from veriflux.operators import retrieval as R
from veriflux.operators import rules as E
from veriflux.operators import stats as V
from veriflux.operators import tuning as U
from veriflux.sources import tables
from veriflux.streaming import evolution, windows


def vectors(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")


def brute(q, x, k, skip_self=False):
    d = ((q[:, None, :].astype(np.float32).astype(float) - x[None].astype(np.float32).astype(float)) ** 2).sum(-1)
    out = set()
    for i, row in enumerate(d):
        order = sorted((v, j) for j, v in enumerate(row) if not (skip_self and i == j))[:k]
        out |= {(i, j, r + 1) for r, (_, j) in enumerate(order)}
    return out


def test_knn_is_exact_with_ties_and_small_banks(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, (60, 4)).astype(float)
    bank = vectors(spark, x).repartition(5)
    got = {(r.query_id, r.vec_id, r.rank) for r in K.knn(vectors(spark, x[:7]), bank, 4, exclude_self=True).collect()}
    assert got == brute(x[:7], x, 4, True)
    assert len(K.knn(vectors(spark, x[:2]), vectors(spark, x[:3]), 10).collect()) == 6
    assert K.knn(vectors(spark, x[:2]), bank, 0).collect() == [] == K.knn(bank.limit(0), bank, 3).collect()
    only = bank.filter("vec_id % 2 = 0")
    assert {r.vec_id % 2 for r in K.knn(vectors(spark, x[:2]), bank, 3, subset=only).collect()} == {0}
    near = K.range_search(vectors(spark, x[:3]), bank, 2.0).collect()
    assert {(r.query_id, r.vec_id) for r in near} == {(i, j) for i in range(3) for j in range(60) if ((x[i] - x[j]) ** 2).sum() < 2}


def test_ivf_recall(spark):
    x = np.random.default_rng(2).normal(size=(800, 8))
    bank = vectors(spark, x)
    exact = {(r.query_id, r.vec_id) for r in K.knn(vectors(spark, x[:40]), bank, 5).collect()}
    found = {(r.query_id, r.vec_id) for r in K.IvfIndex(bank, 12).search(vectors(spark, x[:40]), 5, nprobe=7).collect()}
    assert len(exact & found) / len(exact) >= 0.9


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_registered_ivf_query_recalls_the_exact_neighbours(spark, size):
    from veriflux.plans import registry

    sf = f"/root/testdata/{size}"
    exact = {(r.query_id, r.vec_id) for r in registry.queries()["r1_knn_topk"](spark, sf).collect()}
    found = {(r.query_id, r.vec_id) for r in registry.queries()["r5_ivf_topk"](spark, sf).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_fusion_by_key_and_its_limits(spark):
    v = spark.createDataFrame([(1, 0.1), (2, 0.5), (3, 2.0)], "node_id long, distance double")
    m = spark.createDataFrame([(2, 1.0), (9, 1.0)], "node_id long, score double")
    got = {r.node_id: r.fused for r in R.fuse_weighted(v, m, 0.7).collect()}
    assert got[9] == pytest.approx(0.3) and got[2] == pytest.approx(0.7 * (1 - 0.5 / (2 + 1e-6)) + 0.3) and got[3] == pytest.approx(0.0, abs=1e-6)
    rrf = {r.node_id: r.fused for r in R.fuse_rrf(v, m).collect()}
    assert rrf[2] == pytest.approx(1 / 62 + 1 / 61) and rrf[9] == pytest.approx(1 / 62)
    with pytest.raises(ValueError):
        R.fuse_weighted(v, m, 1.5)
    with pytest.raises(ValueError):
        R.fuse_rrf(v, m, 0)
    with pytest.raises(ValueError):
        R.condition("a b", "=", 1)
    nodes = spark.createDataFrame([(1, "p", '{"code": 5, "name": "Ab"}'), (2, "p", '{"code": 7, "name": "zab"}'), (3, "q", '{"code": 5}')], "id long, type string, properties string")
    assert [r.node_id for r in R.metadata_search(nodes, [("code", "IN", 5)], ["p"]).collect()] == [1]
    assert [r.node_id for r in R.metadata_search(nodes, [("name", "LIKE", "a%")]).collect()] == [1]


NODES = [(i, "t", f'{{"v": "{c}"}}') for i, c in enumerate("ABCDE", 1)]


def test_walk_takes_the_least_depth(spark):
    nodes = spark.createDataFrame(NODES, "id long, type string, properties string")
    edges = spark.createDataFrame([(1, 2, "r"), (2, 3, "r"), (1, 3, "r"), (3, 4, "r"), (4, 5, "r"), (5, 5, "r"), (1, 3, "r"), (2, 99, "r"), (1, 5, "other")], "source_id long, target_id long, relationship string")
    start = nodes.filter("id = 1").select("id")
    assert {r.node_id: r.depth for r in G.traverse(nodes, edges, start, "r", 3).collect()} == {1: 0, 2: 1, 3: 1, 4: 2, 5: 3}
    assert {r.node_id: r.depth for r in G.traverse(nodes, edges, nodes.filter("id = 5").select("id"), "r", 2, reverse=True).collect()} == {5: 0, 4: 1, 3: 2}
    assert [r.value for r in G.resolve_path(nodes, edges, "t->r.v").collect()] == ["E"]
    with pytest.raises(ValueError):
        G.resolve_path(nodes, edges, "t.v")


def test_store_logs_and_restores(spark):
    s = G.GraphStore(spark)
    a, b = s.insert_nodes([("m", '{"x": 1}'), ("m", "{}")])
    s.snapshot("one")
    s.insert_edge(a, b, "r")
    s.update_node(a, '{"x": 2}')
    s.set_field(a, "y", 3)
    s.delete_node(b)
    s.delete_node(77)
    assert s.get_node(a).properties == '{"x": 2, "y": 3}' and s.find_by_type("m").count() == 1
    assert [(r.op, r.version, r.before) for r in G.history(s.log, "node", a).collect()] == [("Insert", 1, ""), ("Update", 2, '{"x": 1}')]
    for _ in range(2):
        s.restore("one")
        assert s.nodes.count() == 2 and s.edges.count() == 0
    with pytest.raises(ValueError):
        s.insert_edge(a, b, "")
    with pytest.raises(KeyError):
        s.get_node(123)


def matched(spark, yaml, **facts):
    df = spark.createDataFrame([tuple(facts.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in facts.items()))
    row = E.evaluate(df, E.load_rules("rule_sets:\n  s:\n" + yaml)).first()
    return {r.rule: r.matched for r in row.resolved}


def test_missing_facts_poison_unless_skipped(spark):
    rules = """
    - {name: and_skips, condition: {not: {and: [{field: x, op: ">", value: 9}, {field: none, op: ">", value: 0}]}}}
    - {name: and_fails, condition: {and: [{field: x, op: ">", value: 0}, {field: none, op: ">", value: 0}]}}
    - {name: or_skips, condition: {or: [{field: x, op: ">", value: 0}, {field: none, op: ">", value: 0}]}}
    - {name: or_fails, condition: {or: [{field: none, op: ">", value: 0}, {field: x, op: ">", value: 0}]}}
    - {name: not_missing, condition: {not: {field: none, op: ">", value: 0}}}
    - {name: not_one, condition: {not: {field: x, op: ">", value: 9}}}
    - {name: not_two, condition: {not: {field: x, op: ">", value: 0}}}
    - {name: always}
    - {name: bare_number, condition: {field: x}}
"""
    assert matched(spark, rules, x=1.0) == {"and_skips": True, "and_fails": False, "or_skips": True, "or_fails": False, "not_missing": False, "not_one": True, "not_two": False, "always": True, "bare_number": False}


def test_overrides(spark):
    chain = "    - {name: a, overrides: [b]}\n    - {name: b, overrides: [c], priority: 99}\n    - {name: c}\n    - {name: d, condition: {value: false}, overrides: [a]}\n"
    assert matched(spark, chain, x=1.0) == {"a": True, "b": False, "c": False, "d": False}
    cycle = "    - {name: a, overrides: [b]}\n    - {name: b, overrides: [a], condition: {field: x, op: '>', value: 0}}\n"
    assert matched(spark, cycle, x=1.0) == {"a": True, "b": True}
    assert matched(spark, cycle, x=-1.0) == {"a": True, "b": False}
    with pytest.raises(ValueError):
        E.load_rules("rule_sets: {s: [{condition: {value: true}}]}")
    with pytest.raises(ValueError):
        E.compile_condition({"field": "x", "op": "~", "value": 1}, {"x": "double"})


def test_tree_keys_in_order_of_their_text(spark):
    tree, mapping = T.load_tree("type: branch\nfield: x\nbranches:\n  '>9': {type: leaf, label: nine}\n  '>10': {type: leaf, label: ten}\ndefault: {type: leaf, label: low, formulas: [{weights: [1.0, 5.0], features: [x, none], threshold: 0.0}]}\n")
    df = spark.createDataFrame([(11.0,), (9.5,), (0.0,), (None,)], "x double").withColumn("leaf", T.walk(tree, {"x": "double"}))
    assert [(r.leaf.label, r.leaf.score) for r in df.collect()] == [("ten", 0.0), ("nine", 0.0), ("low", 0.5), ("low", 0.5)]
    with pytest.raises(ValueError):
        T.load_tree("type: branch\nfield: x\nbranches: {}\n")


def test_image_kernels():
    mask = np.zeros((5, 5), bool)
    mask[0, 0] = mask[1, 1] = mask[3, 3] = mask[3, 4] = True
    scores = np.arange(25.0).reshape(5, 5)
    got = I.regions(mask, scores)
    assert [(r["x"], r["y"], r["w"], r["h"], r["area"], r["max_score"]) for r in got] == [(3, 3, 2, 1, 2, 19.0), (1, 1, 1, 1, 1, 6.0), (0, 0, 1, 1, 1, 0.0)]
    assert np.allclose(I.upsample(np.full((3, 4), 2.0), 9, 7), 2.0)
    assert np.allclose(I.gaussian_blur(np.ones((6, 6)), 2.0), 1.0) and (I.gaussian_blur(scores, 0) == scores).all()
    assert (I.stretch(np.full((2, 2), 7, np.uint8)) == 7).all()
    assert np.allclose(I.undistort(scores, 1, 1, 2, 2, (0, 0, 0, 0, 0)), scores)
    assert I.debayer_rggb(np.arange(16).reshape(4, 4)).shape == (4, 4, 3)
    assert I.bounding_box([(1, 2, 3, 4), (0, 5, 2, 2)]) == (0, 2, 4, 5) and I.crop(scores, (1, 2, 2, 9)).shape == (3, 2)
    assert I.binarise(np.arange(100.0)).sum() == 16 and I.binarise(np.array([0.0, 0.1, 0.9, 1.0]), "otsu").tolist() == [0, 0, 1, 1]
    assert I.aggregate_layers([np.ones(2), None, np.ones(2) * 3], "group", [[0, 1], [2]]).tolist() == [0.5, 0.5, 3.0, 3.0]
    d = I.detection(np.array([[0.0, 0], [0, 5.0]]), 8, 8, 1.0, 2.0)
    assert d["image_score"] == 5.0 and len(d["regions"]) == 1


def test_pca_and_coreset(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 6)) @ np.diag([5, 3, 1, 1, 0.5, 0.1]) + 2
    bank = vectors(spark, x).repartition(4)
    p = L.fit_pca(bank, 3)
    x32 = x.astype(np.float32).astype(float)
    values = np.sort(np.linalg.eigvalsh(np.cov(x32.T, ddof=0)))[::-1][:3]
    assert np.allclose(p.eigenvalues, values) and np.allclose(p.components @ p.components.T, np.eye(3))
    assert np.allclose(L.Pca.from_df(p.to_df(spark)).components, p.components)
    z = np.array([r.embedding for r in L.project(bank, p.components, p.mean).orderBy("vec_id").collect()])
    assert np.allclose(z.var(axis=0), values)
    white = np.array([r.embedding for r in L.project(bank, L.fit_whitening(bank, 3)).collect()])
    assert np.allclose(white.var(axis=0), 1)
    picks = L.greedy_coreset(bank.withColumn("key", F.lit(0)), 8, "key").orderBy("pick").collect()
    assert [r.vec_id for r in picks] == L.greedy_indices(x32, 8).tolist()
    cover = L.coverage(bank, spark.createDataFrame(picks)).first()
    d = np.sqrt(((x32[:, None] - x32[[r.vec_id for r in picks]][None]) ** 2).sum(-1)).min(axis=1)
    assert cover.largest == pytest.approx(d.max()) and cover.mean == pytest.approx(d.mean())


def test_statistics(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([5, 1, 4, 2, 3])], "vec_id long, d2 double")
    assert V.rank_pick(df, "d2", 0.5).first().d2 == 3.0 and V.rank_pick(df, "d2", 0.99).first().d2 == 4.0
    p = V.normality_profile(df).first()
    assert (p.p50, p.p95, p.mean) == (3.0, 4.0, 3.0) and p.stddev == pytest.approx(np.std([1, 2, 3, 4, 5])) and p.self_normalcy == 0.0
    assert [r.vec_id for r in V.stride_sample(df, 2, "vec_id").orderBy("vec_id").collect()] == [0, 2]
    days = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 1.1, 0.9, 1.0, 1.0, 5.0, 5.0, 5.0])], "k string, day int, x double")
    assert [r.day for r in V.drift(days, ["k"], "day", "x").filter("drift").collect()] == [7]
    unit = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(l2_normalised("v").alias("v")).collect()
    assert [r.v for r in unit] == [[0.6, 0.8], [0.0, 0.0]]


def test_numbers_do_not_depend_on_the_columns_that_are_read(spark):
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "8k"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(0, 8000, 1, 8).select(((F.col("id") * 7919) % 8000).alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.rand(3).cast("float")).alias("embedding"))
        assert [r for r in V.numbered(df, "vec_id").select("vec_id", "embedding", "_index").collect() if r.vec_id != r._index] == []
        assert sorted(r.vec_id for r in V.stride_sample(df, 100, "vec_id").select("vec_id", "embedding").collect()) == list(range(0, 8000, 80))
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_costs_and_queues(spark):
    truth = spark.createDataFrame([(None, False, False)] * 8 + [(None, False, True)] * 2, "score double, stored_ng boolean, is_ng boolean")
    assert Q.confusion_cost(truth.withColumn("machine_ng", F.col("stored_ng"))).first().cost == 1.0
    assert Q.confusion_cost(truth.limit(0).withColumn("machine_ng", F.col("stored_ng"))).first().cost == 0.0
    assert [r.cost for r in Q.threshold_replay(truth, [0.1, 0.9]).collect()] == [1.0, 1.0]
    items = spark.createDataFrame([("q", i) for i in (1, 2, 3)], "k string, i int")
    assert sorted(r.i for r in Q.drop_oldest(items, "k", ["i"], 2).collect()) == [2, 3]


def test_optimiser_finds_minima_and_keeps_constraints():
    space = U.Space([U.Parameter("x", -2, 2), U.Parameter("y", -2, 2, 0.25)], [({"x": 1, "y": 1}, 1.0)])
    opt = U.BayesOpt(space, rounds=25)
    best, value = opt.run(lambda p: (p[0] - 0.5) ** 2 + (p[1] + 0.5) ** 2)
    assert value < 0.05 and all(space.feasible(x) for x, _ in opt.seen)
    with pytest.raises(ValueError):
        opt.add([], 1.0)
    applied = []
    cycle = U.TuningCycle(U.BayesOpt(U.Space([U.Parameter("t", 0, 1)]), rounds=8), lambda p: (p[0] - 0.3) ** 2 + 0.01, [0.9])
    assert cycle.run(applied.append, lambda: False) == "rolled back" and applied[-1] == [0.9] and [e[0] for e in cycle.events] == ["PROPOSED", "APPLIED", "ROLLBACK"]
    assert cycle.run(applied.append, lambda: True) == "committed"


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcde"), st.sampled_from("abcde")), max_size=8))
def test_cycles(edges):
    reach = {(a, b) for a, b in edges}
    for k in "abcde":
        reach |= {(a, b) for a in "abcde" for b in "abcde" if (a, k) in reach and (k, b) in reach}
    assert E.has_cycle(edges) == any((n, n) in reach for n in "abcde")


def test_sources(spark, tmp_path):
    x = np.arange(12, dtype="<f4").reshape(4, 3)
    (tmp_path / "b.f32").write_bytes(x.tobytes())
    rows = tables.read_bank(spark, str(tmp_path / "b.f32"), 3).orderBy("row").collect()
    assert [r.embedding for r in rows] == x.tolist()
    with pytest.raises(Exception, match="whole vectors"):
        tables.read_bank(spark, str(tmp_path / "b.f32"), 5).collect()
    (tmp_path / "m.yaml").write_text("surface: s\nimages:\n  - {path: a.png, position: 2}\n  - {path: /abs/b.png, expected: NG}\n")
    got = tables.read_manifest(spark, str(tmp_path / "m.yaml")).collect()
    assert got[0].path.endswith("/a.png") and (got[0].surface_id, got[0].position_id) == ("s", 2) and (got[1].path, got[1].expected) == ("/abs/b.png", "NG")
    (tmp_path / "i").mkdir()
    for n in ("b.png", "a.jpg", "c.tif"):
        (tmp_path / "i" / n).write_bytes(b"x")
    assert [r.path.rsplit("/", 1)[1] for r in tables.scan_images(spark, str(tmp_path / "i")).collect()] == ["a.jpg", "b.png"]


def test_stream_equals_batch(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    stream = windows.timed(windows.event_stream(spark, f"{sf}/events.parquet*", batch.schema))
    q = windows.tumbling(stream, "1 day", "event_type").writeStream.outputMode("complete").format("memory").queryName("days").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(90)
    expected = {(str(r.start), r.event_type, r.n) for r in windows.tumbling(windows.timed(batch), "1 day", "event_type").collect()}
    assert {(str(r.start), r.event_type, r.n) for r in spark.table("days").collect()} == expected


def test_evolution(spark, tmp_path):
    rng = np.random.default_rng(6)
    bank = vectors(spark, rng.normal(size=(200, 4)))
    profile = V.normality_profile(V.kth_distances(bank, 5)).first()
    new = rng.normal(size=(60, 4)) * 0.4 + 0.9
    patches = vectors(spark, new, 1000).withColumn("frame_id", F.floor(F.col("vec_id") / 10))
    assert set(evolution.offer(patches, bank, profile).columns) >= {"frame_id", "vec_id", "embedding", "normalcy"}
    patches.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(patches.schema).parquet(str(tmp_path / "in"))
    evolution.start(stream, bank, profile, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(90)
    held = patches.withColumn("batch_id", F.lit(0))
    cfg = evolution.EvolutionConfig(target=150, trigger_frames=3, max_frames=4)
    assert evolution.triggered(held, cfg) and evolution.buffered(held, cfg).select("frame_id").distinct().count() == 4
    version, changed = evolution.update(bank, held, cfg)
    assert version.count() == (150 if changed else 200)
    assert not evolution.update(bank, held, evolution.EvolutionConfig(target=3, least_coverage_share=0.99))[1]
