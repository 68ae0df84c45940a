import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriflux.operators import image as I
from veriflux.operators.linalg import Pca
from veriflux.plans import topology as P
from veriflux.sources import images, models, tables

RGB = np.random.default_rng(3).integers(0, 256, (7, 9, 3)).astype(np.uint8)


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(x, filters=(0,), colour=2, depth=8, extra=b""):
    """An independent encoder, with the filters in turn."""
    h, w, c = x.shape
    raw = x.astype(">u2").view(np.uint8).reshape(h, -1) if depth == 16 else x.reshape(h, -1)
    step, out = c * depth // 8, b""
    rows = np.vstack([np.zeros((1, raw.shape[1]), int), raw.astype(int)])
    for y in range(1, h + 1):
        f = filters[(y - 1) % len(filters)]
        line = []
        for i in range(raw.shape[1]):
            a, b, c0 = (rows[y, i - step] if i >= step else 0), rows[y - 1, i], (rows[y - 1, i - step] if i >= step else 0)
            near = min((a, b, c0), key=lambda v: abs(a + b - c0 - v))
            line.append((rows[y, i] - (0, a, b, (a + b) // 2, near)[f]) % 256)
        out += bytes([f, *line])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


def bmp(x, up=True):
    h, w, _ = x.shape
    body = b"".join(r[:, ::-1].tobytes().ljust((w * 3 + 3) // 4 * 4, b"\0") for r in (x[::-1] if up else x))
    return struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h if up else -h, 1, 24, 0, len(body), 0, 0, 0, 0) + body


def tiff(x, e="<"):
    raw = x.astype(x.dtype.newbyteorder(e)).tobytes()
    tags = [(256, 3, x.shape[1]), (257, 3, x.shape[0]), (258, 3, x.itemsize * 8), (259, 3, 1), (273, 4, 8), (277, 3, x.shape[2]), (279, 4, len(raw))]
    entries = b"".join(struct.pack(e + "HHI", t, k, 1) + (struct.pack(e + "HH", v, 0) if k == 3 else struct.pack(e + "I", v)) for t, k, v in tags)
    return (b"II*\0" if e == "<" else b"MM\0*") + struct.pack(e + "I", 8 + len(raw)) + raw + struct.pack(e + "H", len(tags)) + entries + bytes(4)


def test_decoders():
    deep = RGB.astype(np.uint16) * 257 - 3
    same = lambda data, x: np.array_equal(images.decode(data), x)
    assert same(b"P6\n# note\n9 7\n255\n" + RGB.tobytes(), RGB) and same(b"P5 9 7 255\n" + RGB[..., 0].tobytes(), RGB[..., :1])
    assert same(b"P6 9 7 65535 " + deep.astype(">u2").tobytes(), deep)
    assert same(bmp(RGB), RGB) and same(bmp(RGB, False), RGB)
    for f in range(5):
        assert same(png(RGB, (f,)), RGB)
    assert same(png(RGB, (4, 3, 2, 1, 0)), RGB) and same(png(deep, (1, 4), depth=16), deep)
    assert same(png(np.dstack([RGB, RGB[..., :1]]), (2,), colour=6), RGB)
    index = RGB[..., :1] % 4
    assert same(png(index, colour=3, extra=chunk(b"PLTE", RGB[0, :4].tobytes())), RGB[0, :4][index[..., 0]])
    assert same(tiff(RGB), RGB) and same(tiff(deep, ">"), deep)
    for bad in (b"", b"\xff\xd8\xff\xe0", b"P6 9 7 255\n12", png(RGB)[:50], bmp(RGB)[:60], tiff(RGB)[:-40], png(RGB, colour=5)):
        with pytest.raises(ValueError):
            images.decode(bad)


def test_images_to_patches(spark, tmp_path):
    big = np.random.default_rng(4).integers(0, 256, (14, 28, 3)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(png(big, (1,)))
    (tmp_path / "b.bmp").write_bytes(bmp(big))
    read = images.read_images(spark, str(tmp_path))
    rows = {r.path.rsplit("/", 1)[1]: r for r in read.collect()}
    assert {(r.width, r.height, r.channels, r.bits, bytes(r.pixels)) for r in rows.values()} == {(28, 14, 3, 8, big.tobytes())}
    got = I.embed_patches(read, 7, 40).orderBy("path", "patch_id").collect()
    assert [r.patch_id for r in got] == [*range(8)] * 2 and got[3].embedding == got[11].embedding
    assert np.allclose(got[3].embedding, I.patch_features(big, 7, 40)[3], atol=1e-6)
    (tmp_path / "c.png").write_bytes(b"no image")
    with pytest.raises(Exception, match="neither PNM"):
        images.read_images(spark, str(tmp_path)).collect()


def test_patch_features():
    n = 7 * 7 * 3
    flat = I.patch_features(np.full((7, 14, 3), 100, np.uint8), 7, 1000, False)
    assert flat.shape == (2, 1000) and (flat[0] == flat[1]).all()
    v = flat[0]
    assert np.allclose(v[:n], 100 / 255) and [v[n + 16 * c + 6] for c in range(3)] == [1, 1, 1]
    assert np.allclose(v[n + 48 : n + 60].reshape(3, 4), [100 / 255, 0, 0, 0]) and v[n + 60] == 1
    assert v[n + 76 : n + 85].sum() == 0 and v[n + 85] == 1 and np.allclose(v[n + 95 : n + 122], 100 / 255) and not v[n + 122 :].any()
    ramp = np.tile((np.arange(7) * 20).astype(np.uint8)[None, :, None], (7, 1, 3))
    v = I.patch_features(ramp, 7, 1000, False)[0]
    assert np.isclose(v[n + 76], 1) and np.isclose(v[n + 85 + 3], 1)  # gradients along x; three neighbours are brighter
    x = ramp[..., 0].astype(float).ravel()
    assert np.isclose(v[n + 49], x.std() / 255) and np.isclose(v[n + 51], ((x - x.mean()) ** 4).mean() / x.var() ** 2 / 5 - 0.6)
    short = I.patch_features(RGB[:6, :6], 6, 50)
    assert short.shape == (1, 50) and np.allclose((short**2).sum(), 1)
    for bad in (lambda: I.grid_of(7, 9, 2), lambda: I.grid_of(0, 4, 2), lambda: I.patch_features(RGB[..., 0][:6, :6], 6)):
        with pytest.raises(ValueError):
            bad()


def test_highlights():
    x = np.full((9, 9, 3), 0.2)
    x[..., 0] = 0.6
    x[4, 4] = 1.0
    mask, strength, sure = I.specular_cues(x, 0.5)
    assert mask.sum() == mask[4, 4] == 1 and np.allclose(strength + sure, 1) and strength[4, 4] == 1
    assert np.isclose(strength[0, 0], sum(w / (1 + np.exp(a)) for w, a in ((0.5, 15 * (0.85 - 0.2126 * 0.6**2.2 - 0.7874 * 0.2**2.2)), (0.3, 10 * (2 / 3 - 0.25)))))
    scores = np.zeros((9, 9))
    scores[4, 4] = 2.0
    assert I.suppress_highlights(scores, sure, 2.0)[4, 4] < 0.1
    assert np.allclose(I.suppress_highlights(scores, np.ones((9, 9)), 2.0), scores)
    assert I.resize(RGB, 3, 4).shape == (3, 4, 3) and (I.resize(RGB, 7, 9) == RGB).all()
    assert I.resize(np.array([[0, 3]], np.uint8), 1, 4).tolist() == [[0, 0, 2, 3]]


def test_model_files():
    p = Pca(np.arange(3.0), np.arange(6.0).reshape(2, 3), np.array([2.0, 0.5]))
    data = models.pca_bytes(p)
    q = models.pca_from_bytes(data)
    assert len(data) == 16 + 4 * 11 and all(np.array_equal(getattr(p, a), getattr(q, a)) for a in ("mean", "components", "eigenvalues"))
    for bad in (b"", data[:-1], bytes(16)):
        with pytest.raises(ValueError):
            models.pca_from_bytes(bad)
    profile = {"k_nearest": 3, "dim": 8, "num_samples": 100} | {k: i / 8 for i, k in enumerate(models.STATISTICS)}
    assert models.profile_from_yaml(models.profile_yaml(profile)) == profile
    assert models.profile_from_yaml("profile: {dim: 4}")["k_nearest"] == 5
    with pytest.raises(ValueError):
        models.profile_from_yaml("other: 1")


def test_heatmaps(spark):
    x = np.array([[0.0, 1.0], [2.0, 4.0]])
    ppm = models.heatmap(x, 4, 4)
    assert ppm.startswith(b"P6\n4 4\n255\n")
    at = images.decode(ppm)
    assert [at[y, c].tolist() for y, c in ((0, 0), (1, 3), (2, 0), (3, 3))] == [[0, 0, 255], [0, 255, 255], [0, 255, 0], [255, 0, 0]]
    assert (images.decode(models.heatmap(np.ones((2, 2)), 3, 3)) == [0, 0, 255]).all()
    df = spark.createDataFrame([(1, x.ravel().tolist()), (2, []), (3, None)], "frame_id long, scores array<double>")
    got = {r.frame_id: r.ppm for r in models.heatmaps(df, (2, 2), (4, 4)).collect()}
    assert bytes(got[1]) == ppm and got[2] is got[3] is None


GOOD = """
pipeline:
  name: line
  version: "1.0"
  backpressure: {default: block, stage_overrides: {c: drop_oldest}}
  stages:
    - {id: x, type: Export, depends_on: [r]}
    - {id: c, type: Capture}
    - {id: p, type: Preprocess, depends_on: [c], config: {by: 2}}
    - {id: i, type: Inference, depends_on: [p]}
    - {id: d, type: Detect, depends_on: [i]}
    - {id: f, type: RuleEval, depends_on: [d]}
    - {id: r, type: Reason, depends_on: [f]}
"""


def test_review_index_has_a_bounded_number_of_files(spark, tmp_path):
    frames = spark.range(0, 3000, 1, 4).select((F.col("id") % 500).alias("surface_id"), F.col("id").alias("frame_id"), F.lit("OK").alias("verdict"), (F.col("id") % 4).alias("position_id"))
    frames = frames.unionByName(frames.limit(1).withColumn("surface_id", F.lit(None).cast("long")))
    tables.write_review_index(frames, str(tmp_path / "index"), parts=8)
    folders = [p for p in (tmp_path / "index").iterdir() if p.is_dir()]
    assert len(folders) <= 8 and sum(len(list(p.glob("*.json"))) for p in folders) <= 8 * 5
    back = spark.read.schema("surface_id long, frame_id long, verdict string, position_id long").json(str(tmp_path / "index"))
    assert sorted(map(str, back.drop("part").collect())) == sorted(map(str, frames.collect()))
    assert back.groupBy("surface_id").agg(F.count_distinct("part").alias("n")).filter("n > 1").count() == 0


def test_topology(spark):
    stages = P.load_topology(GOOD)
    assert [s.id for s in stages] == ["c", "p", "i", "d", "f", "r", "x"] and [s.policy for s in stages][:2] == ["drop_oldest", "block"]
    out = P.run_topology(stages, spark.range(4), {"Preprocess": lambda df, c: df.withColumn("v", F.col("id") * c["by"]), "Detect": lambda df, c: df.filter("v > 2")})
    assert sorted(r.v for r in out.collect()) == [4, 6]
    for old, new, why in (
        ("name: line", "name: ''", "name"), ('"1.0"', '"1"', "version"), ("{id: c, type: Capture}", "{id: x, type: Capture}", "ids"), ("depends_on: [i]", "depends_on: [zz]", "unknown"),
        ("depends_on: [c]", "depends_on: [r]", "depend on each other"), ("type: Detect", "type: Custom", "unknown type"), ("depends_on: [i]", "depends_on: [p]", "several"),
        ("{id: c, type: Capture}", "{id: c, type: Preprocess}", "Capture"), ("type: Export", "type: Reason", "Export"), ("type: Inference", "type: Preprocess", "takes"), ("c: drop_oldest", "c: degrade", "policy"),
    ):
        with pytest.raises(ValueError, match=why):
            P.load_topology(GOOD.replace(old, new, 1))
    with pytest.raises(ValueError):
        P.load_topology("pipeline: {name: a, version: '1.0', stages: []}")
