"""The bootstrap of banks against plain loops, and the record of inspections through a stream."""

import random

import numpy as np
import pytest

from veriflux.operators.linalg import greedy_indices
from veriflux.streaming import bootstrap, recorder

PATCHES = "k string, frame_id long, patch int, vec_id long, embedding array<float>"


def invented(seed=4):
    rng, rows = random.Random(seed), []
    for key, frames in (("a", 5), ("b", 3), ("c", 2)):
        for f in range(frames):
            rows += [(key, f, p, len(rows) + p, [rng.random() for _ in range(3)]) for p in range(rng.choice([3, 8, 13]))]
    return rows + [(None, 0, 0, 900, [0.0, 0.0, 0.0]), ("a", None, 0, 901, [0.0, 0.0, 0.0])]


@pytest.mark.parametrize("min_frames,target", [(3, 12), (3, 9), (2, 4)])
def test_bootstrap_same_as_loops(spark, min_frames, target):
    rows, want = [r for r in invented() if r[0] is not None and r[1] is not None], set()
    for key in "abc":
        frames = sorted({r[1] for r in rows if r[0] == key})
        if len(frames) < min_frames:
            continue
        sample = []
        for f in frames[:min_frames]:
            own = sorted((r for r in rows if r[:2] == (key, f)), key=lambda r: r[2])
            sample += own[:: max(1, len(own) // (target // min_frames))]
        sample.sort(key=lambda r: r[3])
        want |= {(key, sample[i][3]) for i in greedy_indices(np.array([r[4] for r in sample], np.float32).astype(float), target)}
    got = bootstrap.bootstrapped(spark.createDataFrame(invented(), PATCHES), "k", min_frames, target).collect()
    assert len(got) == len(want) and {(r.k, r.vec_id) for r in got} == want


def test_bootstrap_of_nothing(spark):
    none = spark.createDataFrame([], PATCHES)
    assert bootstrap.bootstrapped(none, "k", 2, 4).count() == 0
    with pytest.raises(ValueError):
        bootstrap.bootstrap_sample(none, "k", 5, 4)


def test_records_of_a_stream(spark, tmp_path):
    rows = [(0.5, "OK", "s1", 7), (None, None, "", 0), (0.9, "NG", None, None)]
    spark.createDataFrame(rows, recorder.RECORD).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(recorder.RECORD).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        recorder.record(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(90)
    got = sorted(recorder.recorded(spark, str(tmp_path / "out")).collect(), key=lambda r: str(r.machine_verdict))
    assert [(r.detection_score, r.machine_verdict, r.surface_id) for r in got] == [(0.9, "NG", None), (None, None, None), (0.5, "OK", "s1")]
    assert got[2].timestamp == 7 and min(got[0].timestamp, got[1].timestamp) > 10**15
