"""Detectors, facts, tasks, caches, synthetic frames and tuning files on small invented data."""

import itertools

import numpy as np
import pytest

from veriflux.functions.cache import LruCache
from veriflux.operators import detect, knn, linalg, tuning
from veriflux.plans import topology
from veriflux.sources import synthetic, tables
from veriflux.streaming import evolution


def frame_rows(spark, x, first=0, **columns):
    names = "".join(f", {c} long" for c in columns)
    return spark.createDataFrame([(i // 4, i % 4, v.tolist(), *columns.values()) for i, v in enumerate(x, 4 * first)], "frame_id long, patch long, embedding array<float>" + names)


def bank_rows(spark, x, **columns):
    names = "".join(f", {c} long" for c in columns)
    return spark.createDataFrame([(i, v.tolist(), *columns.values()) for i, v in enumerate(x)], "vec_id long, embedding array<float>" + names)


@pytest.mark.parametrize("block", [3, 1000])
def test_block_join_matches_all_pairs(spark, block):
    rng = np.random.default_rng(block)
    x, y = rng.normal(size=(23, 5)).astype(np.float32), rng.normal(size=(40, 5)).astype(np.float32)
    q = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "query_id long, part long, embedding array<float>")
    b = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(y)], "vec_id long, part long, embedding array<float>")
    got = {(r.part, r.query_id, r.rank): r.vec_id for r in knn.knn_join(q, b, 3, ("part",), block=block).collect()}
    expected = {}
    for i in range(23):
        if i % 3 < 2:  # part 2 has no bank
            near = sorted((float(((x[i].astype(float) - y[j]) ** 2).sum()), j) for j in range(40) if j % 2 == i % 3)[:3]
            expected |= {(i % 3, i, r + 1): j for r, (_, j) in enumerate(near)}
    assert got == expected
    plain = {(r.query_id, r.rank): r.vec_id for r in knn.knn_join(q.drop("part"), b.drop("part"), 2, block=block).collect()}
    assert plain == {(r.query_id, r.rank): r.vec_id for r in knn.knn(q.select("query_id", "embedding"), b, 2).collect()}
    assert knn.knn_join(q, b.limit(0), 3, ("part",)).collect() == [] == knn.knn_join(q.limit(0), b, 3, ("part",)).collect()


def test_many_queries_take_the_block_join(spark, monkeypatch):
    x = np.random.default_rng(0).normal(size=(30, 4)).astype(np.float32)
    bank = bank_rows(spark, x)
    plain = sorted(map(tuple, knn.knn(bank, bank, 2, exclude_self=True).collect()))
    monkeypatch.setattr(knn, "MAX_QUERIES", 29)
    dealt = sorted(map(tuple, knn.knn(bank, bank, 2, exclude_self=True).collect()))
    assert [r[:3] for r in plain] == [r[:3] for r in dealt] and np.allclose([r[3] for r in plain], [r[3] for r in dealt])


def test_detector_finds_the_patch_that_is_off(spark):
    normal = np.zeros((5, 3), np.float32)
    x = np.zeros((8, 3), np.float32)
    x[6] = 2.0
    cfg = detect.DetectorConfig(grid=(2, 2), size=(2, 2), sigma=0.0, threshold=0.5, reference=4.0)
    rows = frame_rows(spark, x).union(frame_rows(spark, x[:3], first=2))
    got = {r.frame_id: r for r in detect.knn_detect(rows, bank_rows(spark, normal), cfg).collect()}
    assert got[0].image_score == 0 and got[0].region is None and got[0].error is None
    assert (got[1].image_score, got[1].x, got[1].y, got[1].area) == (3.0, 0, 1, 1)
    assert "grid of 2 x 2" in got[2].error and got[2].image_score is None
    assert detect.knn_detect(rows.limit(0), bank_rows(spark, normal), cfg).collect() == []


def test_frames_go_to_their_own_bank_or_the_default(spark):
    cfg = detect.DetectorConfig(grid=(2, 2), size=(2, 2), sigma=0.0, threshold=0.5)
    ones, zeros = np.ones((4, 3), np.float32), np.zeros((4, 3), np.float32)
    rows = frame_rows(spark, ones, surface=1).union(frame_rows(spark, ones, first=1, surface=2))
    banks = bank_rows(spark, ones, surface=1)
    got = {r.frame_id: r for r in detect.knn_detect(rows, banks, cfg, keys=("surface",)).collect()}
    assert got[0].image_score == 0 and got[1].error is not None
    got = {r.frame_id: r for r in detect.knn_detect(rows, banks, cfg, keys=("surface",), default=bank_rows(spark, zeros)).collect()}
    assert got[0].image_score == 0 and got[1].image_score == 3.0 and got[1].error is None


def test_whitening_drops_the_leading_components(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 6)) * [9, 5, 3, 2, 1, 0.5]
    matrix, white = linalg.whitened_bank(bank_rows(spark, x.astype(np.float32)), drop_k=2)
    assert matrix.shape == (4, 6)
    got = np.array([r.embedding for r in white.collect()])
    assert np.allclose(np.cov(got.T, ddof=0), np.eye(4), atol=1e-3)
    with pytest.raises(ValueError):
        linalg.whitened_bank(bank_rows(spark, x.astype(np.float32)), drop_k=6)


def test_cache_evicts_what_was_not_used_longest():
    c = LruCache(2)
    c.put("a", 1), c.put("b", 2)
    assert c.get("a") == 1
    c.put("c", 3)
    assert c.get("b") is None and c.get("a") == 1 and c.get("c") == 3 and c.hit_rate() == 0.75
    none = LruCache(0)
    none.put("a", 1)
    assert none.get("a") is None and none.hit_rate() == 0


def test_synthetic_frames_are_the_same_again(spark):
    rows = synthetic.synthetic_frames(spark, 5, 120, 160).collect()
    again = {r.frame_id: bytes(r.pixels) for r in synthetic.synthetic_frames(spark, 5, 120, 160).collect()}
    for r in rows:
        x = np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width)
        assert bytes(r.pixels) == again[r.frame_id] and (x == 30).any() and 100 < np.median(x) < 156
    assert len(set(again.values())) == 5


def test_tasks_run_once_and_failures_spread():
    ran = []
    tasks = {n: (deps, lambda *a, n=n: ran.append(n) or n) for n, deps in {"d": ("b", "c"), "b": ("a",), "c": ("a",), "a": ()}.items()}
    assert {s for s, _ in topology.run_tasks(tasks).values()} == {"done"} and sorted(ran) == list("abcd") and ran[0] == "a" and ran[-1] == "d"
    with pytest.raises(ValueError):
        topology.run_tasks({"a": (("nobody",), lambda x: x)})
    with pytest.raises(ValueError):
        topology.run_tasks({"a": (("b",), lambda x: x), "b": (("a",), lambda x: x)})


def test_write_back_names_what_is_not_there():
    tree = "type: branch\nfield: x\nbranches:\n  a: {type: leaf, label: OK, formulas: [{weights: [1.0], features: [x], threshold: 0.5}]}\ndefault: {type: leaf, label: NG}\n"
    out = tuning.write_back(tree, {"leaf_0.formula_0.weight_0": 3, "verdict_mapping.warn": 0.2})
    assert "3.0" in out and "warn: 0.2" in out and "0.5" in out
    for bad in ("leaf_1.formula_0.threshold", "leaf_0.formula_0.weight_4", "leaf_0", "other.x"):
        with pytest.raises(ValueError):
            tuning.write_back(tree, {bad: 1.0})


def test_files_with_faults_are_named(spark, tmp_path):
    for text in ("tuning: {parameters: []}", "parameters: [{name: a, min: 2, max: 1}]", "parameters: [{name: a, min: 0, max: 1}]\nconstraints: [{lhs: a, rhs: b, bound: 1}]"):
        with pytest.raises(ValueError):
            tuning.load_space(text)
    assert not evolution.config_from_yaml("other: 1").enabled
    with pytest.raises(ValueError):
        evolution.config_from_yaml("self_evolution: 3")
    (tmp_path / "coreset.yaml").write_text("surface: s")
    with pytest.raises(ValueError):
        tables.read_bank_manifest(spark, str(tmp_path))
    (tmp_path / "meta.yaml").write_text("a: {b: 1}")
    assert tables.read_metadata(str(tmp_path / "meta.yaml")) == {"a": {"b": 1}}
    for name, text in (("none.yaml", None), ("bad.yaml", "a: [")):
        if text:
            (tmp_path / name).write_text(text)
        with pytest.raises(ValueError):
            tables.read_metadata(str(tmp_path / name))
    with pytest.raises(ValueError):
        tables.bank_bytes(np.zeros((0, 4)))


def test_one_pass_a_pick_makes_the_same_picks(spark):
    x = np.random.default_rng(3).normal(size=(60, 4)).astype(np.float32)
    bank = bank_rows(spark, x, key=0).repartition(5)
    got = [r.vec_id for r in linalg.exact_coreset(bank, 9).orderBy("pick").collect()]
    assert got == [r.vec_id for r in linalg.greedy_coreset(bank, 9, "key").orderBy("pick").collect()]
    assert len(linalg.exact_coreset(bank.limit(3), 9).collect()) == 3 and linalg.exact_coreset(bank.limit(0), 9).collect() == []


def test_index_files_give_what_the_index_gives(spark, tmp_path):
    x = np.random.default_rng(6).normal(size=(120, 4)).astype(np.float32)
    bank = bank_rows(spark, x)
    found = [sorted(map(tuple, knn.IvfIndex(bank, nlist=8, folder=f).search(bank.limit(10), 3, nprobe=2).collect())) for f in (None, str(tmp_path / "index"))]
    assert found[0] == found[1] and len(found[0]) == 30
    assert len(list((tmp_path / "index").glob("cell=*"))) <= 8


def test_greedy_picks_are_the_furthest():
    x = np.random.default_rng(9).normal(size=(40, 3))
    picks = linalg.greedy_indices(x, 8)
    for n in range(1, 8):
        far = [min(((x[i] - x[j]) ** 2).sum() for j in picks[:n]) if i not in picks[:n] else -1 for i in range(40)]
        assert picks[n] == int(np.argmax(far))
    assert len(set(picks.tolist())) == 8 and list(itertools.islice(picks, 1)) == [0]
