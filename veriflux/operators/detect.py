"""Detectors: patches of frames against banks of normal patches or a PCA model, to scores of frames and regions.

Patches are rows: the frame's key columns, ``patch`` (its number in the grid, row by row), embedding. A frame
whose patches don't make up the grid has an ``error`` and no scores; errors of one frame leave others alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .image import detect
from .knn import knn_join
from .linalg import Pca
from .stats import pca_scores


@dataclass(frozen=True)
class DetectorConfig:
    grid: tuple[int, int]
    size: tuple[int, int]
    sigma: float = 4.0
    threshold: float = 0.8
    reference: float = 1.0
    alpha: float = 0.5
    method: str = "reconstruction"
    drop_k: int = 0


def patch_score(nearest: Column, reference: float) -> Column:
    """Distance to the nearest normal patch, by the bank's own largest."""
    return F.try_divide(nearest, F.lit(float(reference)))


def hybrid_score(nearest: Column, pca: Column, frame: str, alpha: float = 0.5) -> Column:
    """Weighted sum of a patch's score and its PCA score, which is divided by its frame's largest."""
    top = F.max(pca).over(Window.partitionBy(frame))
    return alpha * nearest + (1 - alpha) * F.when(top > 0, pca / top).otherwise(pca)


def pca_patch_scores(patches: DataFrame, pca: Pca, cfg: DetectorConfig) -> Column:
    return pca_scores(F.col("embedding"), pca.mean.tolist(), pca.components.tolist(), pca.eigenvalues.tolist(), cfg.drop_k)[cfg.method]


def _result(scored: DataFrame, cfg: DetectorConfig, frame: str) -> DataFrame:
    """``scored``: frame, patch, score. One row a region (or a frame without any): frame, error, image_score, region, ..."""
    h, w = cfg.grid
    grids = scored.groupBy(frame).agg(F.array_sort(F.collect_list(F.struct("patch", "score"))).alias("p"))
    whole = (F.size("p") == h * w) & (F.get("p.patch", F.lit(0)) == 0) & (F.get("p.patch", F.size("p") - 1) == h * w - 1) & (F.size(F.array_distinct("p.patch")) == h * w) & ~F.exists("p.score", lambda x: x.isNull())
    grids = grids.select(frame, F.when(~whole, F.lit(f"patches do not make a grid of {h} x {w}, or have no bank")).alias("error"), F.col("p.score").alias("scores"))
    good = detect(grids.filter("error is null"), cfg.grid, cfg.size, cfg.sigma, cfg.threshold, key=frame)
    return good.withColumn("error", F.lit(None).cast("string")).unionByName(grids.filter("error is not null").select(frame, "error"), allowMissingColumns=True)


def knn_detect(patches: DataFrame, banks: DataFrame, cfg: DetectorConfig, *, frame: str = "frame_id", keys: tuple[str, ...] = (), default: DataFrame | None = None, pca: Pca | None = None) -> DataFrame:
    """Nearest-neighbour detection of frames, each against the bank of its ``keys`` (surface, position), or ``default`` (vec_id, embedding), if its keys have none.

    Frames without any bank have an error. With ``pca`` the scores are hybrid ones.
    """
    rows = patches.withColumn("query_id", F.col(frame) * (cfg.grid[0] * cfg.grid[1]) + F.col("patch"))
    found = knn_join(rows.select(*keys, "query_id", "embedding"), banks, 1, keys).select("query_id", "d2")
    if keys and default is not None:
        known = banks.select(*keys).distinct()
        other = rows.join(known, list(keys), "left_anti")
        found = found.unionByName(knn_join(other.select("query_id", "embedding"), default, 1).select("query_id", "d2"))
    scored = rows.join(found, "query_id", "left").withColumn("score", patch_score(F.col("d2"), cfg.reference))
    if pca is not None:
        scored = scored.withColumn("pca", pca_patch_scores(scored, pca, cfg)).withColumn("score", hybrid_score(F.col("score"), F.col("pca"), frame, cfg.alpha))
    return _result(scored.select(frame, "patch", "score"), cfg, frame)


def pca_detect(patches: DataFrame, pca: Pca, cfg: DetectorConfig, frame: str = "frame_id") -> DataFrame:
    """Detection by PCA scores alone, each divided by its frame's largest."""
    scored = patches.withColumn("pca", pca_patch_scores(patches, pca, cfg))
    top = F.max("pca").over(Window.partitionBy(frame))
    return _result(scored.select(frame, "patch", F.when(top > 0, F.col("pca") / top).otherwise(F.col("pca")).alias("score")), cfg, frame)
