"""Synthetic camera frames: striped surfaces with a few dark discs, the same for the same number."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package

#: Brightness and height of the stripes, their period, and the radii of the discs.
LEVEL, AMPLITUDE, PERIOD, RADII = 128, 24, 128, (15, 35)


def synthetic_frame(number: int, h: int, w: int) -> np.ndarray:
    """A grey picture of 8 bits with two or three discs."""
    rng = np.random.default_rng(number)
    x = LEVEL + AMPLITUDE * np.sin(2 * np.pi * np.arange(w) / PERIOD)
    out = np.tile(x, (h, 1))
    rows, cols = np.mgrid[0:h, 0:w]
    for _ in range(int(rng.integers(2, 4))):
        r, cy, cx = int(rng.integers(RADII[0], RADII[1] + 1)), int(rng.integers(0, h)), int(rng.integers(0, w))
        out[(rows - cy) ** 2 + (cols - cx) ** 2 <= r * r] = 30
    return out.astype(np.uint8)


def synthetic_frames(spark: SparkSession, n: int, h: int = 240, w: int = 320) -> DataFrame:
    """frame_id, height, width, pixels of ``n`` frames; tasks make them. A stream's numbers (the rate source) can take the place of the range."""
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                ids = batch.column(0).slice(at, 32)
                pixels = [synthetic_frame(i, h, w).tobytes() for i in ids.to_pylist()]
                yield pa.RecordBatch.from_arrays([ids, pa.array([h] * len(ids), pa.int32()), pa.array([w] * len(ids), pa.int32()), pa.array(pixels, pa.binary())], ["frame_id", "height", "width", "pixels"])

    return spark.range(n).mapInArrow(run, "frame_id long, height int, width int, pixels binary")
