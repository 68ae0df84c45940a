"""A first bank for keys that have none: a sample of each key's first frames, then a coreset of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.linalg import greedy_coreset


def bootstrap_sample(patches: DataFrame, key: str, min_frames: int = 50, target: int = 10_000, frame: str = "frame_id", patch: str = "patch") -> DataFrame:
    """Of each key with ``min_frames`` frames the first so many, and of each of them every s-th patch, so that about ``target`` are left.

    s is a frame's number of patches by ``target // min_frames``, 1 at least. Keys with
    fewer frames wait: they have no rows. Patches without a key or frame are left out.
    """
    share = target // min_frames
    if share < 1:
        raise ValueError(f"a target of {target} leaves no patch for each of {min_frames} frames")
    patches = patches.dropna(subset=[key, frame])
    sizes = patches.groupBy(key, frame).agg(F.count(F.lit(1)).alias("_n"))
    first = sizes.withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy(frame))).filter(F.col("_at") <= min_frames)
    ready = first.groupBy(key).agg(F.count(F.lit(1)).alias("_frames")).filter(F.col("_frames") == min_frames).select(key)
    strides = first.join(ready, key, "left_semi").select(key, frame, F.greatest(F.lit(1), F.floor(F.col("_n") / share)).alias("_stride"))
    return patches.join(strides, [key, frame]).filter(F.col(patch) % F.col("_stride") == 0).drop("_stride")


def bootstrapped(patches: DataFrame, key: str, min_frames: int = 50, target: int = 10_000, frame: str = "frame_id", patch: str = "patch") -> DataFrame:
    """The first bank of each key that has ``min_frames`` frames: key, vec_id, embedding; ``target`` vectors at most, by furthest-point selection."""
    sample = bootstrap_sample(patches, key, min_frames, target, frame, patch)
    picked = greedy_coreset(sample.select(key, "vec_id", "embedding"), target, key)
    return sample.select(key, "vec_id", "embedding").join(picked.select(key, "vec_id"), [key, "vec_id"], "left_semi")
