"""Files of PCA models and normality profiles, and heatmaps of score grids."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..operators.linalg import Pca
from ..session import ship_package

STATISTICS = ("p50", "p95", "p99", "mean", "stddev", "self_normalcy")


def pca_bytes(p: Pca) -> bytes:
    """Dimensions and components as little-endian u64, then mean, eigenvalues and components as float32."""
    k, d = p.components.shape
    return struct.pack("<QQ", d, k) + b"".join(np.asarray(x, "<f4").tobytes() for x in (p.mean, p.eigenvalues, p.components))


def pca_from_bytes(data: bytes) -> Pca:
    d, k = struct.unpack_from("<QQ", data) if len(data) >= 16 else (0, 0)
    if not d or not k or len(data) < 16 + 4 * (d + k + k * d):
        raise ValueError(f"{len(data)} bytes aren't a PCA model of {d} dimensions and {k} components")
    x = np.frombuffer(data, "<f4", d + k + k * d, 16).astype(float)
    return Pca(x[:d], x[d + k :].reshape(k, d), x[d : d + k])


def profile_yaml(profile: dict) -> str:
    import yaml

    known = {k: int(profile.get(k, 0)) for k in ("k_nearest", "dim", "num_samples")}
    return yaml.safe_dump({"profile": known | {"statistics": {k: float(profile.get(k, 0)) for k in STATISTICS}}}, sort_keys=False)


def profile_from_yaml(text: str) -> dict:
    """Fields that the file leaves out are 0, but k_nearest is 5."""
    import yaml

    p = (yaml.safe_load(text) or {}).get("profile")
    if p is None:
        raise ValueError("the file has no 'profile'")
    s = p.get("statistics") or {}
    return {"k_nearest": int(p.get("k_nearest", 5)), "dim": int(p.get("dim", 0)), "num_samples": int(p.get("num_samples", 0))} | {k: float(s.get(k, 0)) for k in STATISTICS}


def heatmap(scores: np.ndarray, h: int = 518, w: int = 518) -> bytes:
    """A grid as a PPM: scaled to its least and greatest score, nearest cells, blue over cyan, green and yellow to red."""
    t = (scores - scores.min()) / (np.ptp(scores) or 1.0)
    rgb = np.stack([np.clip(v, 0, 1) for v in (4 * t - 2, np.minimum(4 * t, 4 - 4 * t), 2 - 4 * t)], axis=-1)
    rows, cols = (np.arange(n) * m // n for n, m in ((h, t.shape[0]), (w, t.shape[1])))
    return b"P6\n%d %d\n255\n" % (w, h) + (rgb * 255).astype(np.uint8)[rows][:, cols].tobytes()


def write_heatmaps(frames: DataFrame, folder: str, grid: tuple[int, int], size: tuple[int, int] = (518, 518), key: str = "frame_id") -> None:
    """A file ``key``.ppm of each frame with a grid; tasks write them, to a file system they share."""
    from pyarrow import fs

    def write(rows):
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        for r in rows:
            with store.open_output_stream(f"{path}/{r[key]}.ppm") as out:
                out.write(bytes(r.ppm))

    heatmaps(frames, grid, size, key).filter("ppm is not null").foreachPartition(write)


def heatmaps(frames: DataFrame, grid: tuple[int, int], size: tuple[int, int] = (518, 518), key: str = "frame_id", scores: str = "scores") -> DataFrame:
    """Score grids (arrays, row by row) as pictures: key, ppm. An empty or null grid gives null."""
    ship_package(frames.sparkSession)

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 16):  # pictures are large
                part = pdf.iloc[at : at + 16]
                ppm = [None if s is None or not len(s) else heatmap(np.asarray(s, float).reshape(grid), *size) for s in part[scores]]
                yield pd.DataFrame({key: part[key], "ppm": ppm})

    return frames.select(key, scores).mapInPandas(run, f"{key} long, ppm binary")
