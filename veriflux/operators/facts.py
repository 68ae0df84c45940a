"""Facts of frames as rows: frame_id, key, number (double), text, source. A key is there once a frame.

Rules and trees read wide frames; ``wide`` gives them, a column for each key asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import resolve_path

SOURCES = ("Direct", "GraphPath", "VectorSearch", "Computed", "Default")
COLUMNS = ["frame_id", "key", "number", "text", "source"]
#: Names of a detection's facts, and the columns of ``image.detect`` they are taken from.
DETECTION = {"detection.image_level_score": "image_score", "detection.anomaly_map.max_score": "map_max", "detection.latency_ns": "latency_ns", "detection.grid_h": "grid_h", "detection.grid_w": "grid_w", "detection.region_count": "region_count"}
REGION = {"max_score": "max_score", "mean_score": "mean_score", "area_pixels": "area", "x": "x", "y": "y", "width": "w", "height": "h"}


def set_facts(base: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` takes the place of facts with its keys."""
    keys = new.select("frame_id", "key")
    return base.join(keys, ["frame_id", "key"], "left_anti").select(*COLUMNS).unionByName(new.select(*COLUMNS))


def set_defaults(base: DataFrame, defaults: dict[str, float | str]) -> DataFrame:
    """``defaults`` for the frames that lack them."""
    rows = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(float(v) if not isinstance(v, str) else None).cast("double").alias("number"), F.lit(v if isinstance(v, str) else None).cast("string").alias("text")) for k, v in defaults.items()])
    new = base.select("frame_id").distinct().select("frame_id", F.explode(rows).alias("r")).select("frame_id", "r.*", F.lit("Default").alias("source"))
    return base.select(*COLUMNS).unionByName(new.join(base.select("frame_id", "key"), ["frame_id", "key"], "left_anti").select(*COLUMNS))


def get(base: DataFrame, key: str) -> DataFrame:
    return base.filter(F.col("key") == key)


def wide(base: DataFrame, numbers: list[str] = (), texts: list[str] = ()) -> DataFrame:
    """A row a frame, with a column for each key; a fact that isn't there is null, which rules take for missing."""
    pick = lambda k, c: F.max(F.when(F.col("key") == k, F.col(c))).alias(k)
    return base.groupBy("frame_id").agg(*[pick(k, "number") for k in numbers], *[pick(k, "text") for k in texts])


def detection_facts(detections: DataFrame, grid: tuple[int, int], latency_ns: str | None = None) -> DataFrame:
    """Facts of ``image.detect``'s rows; those of the first region only where there is one."""
    first = lambda c: F.max(F.when(F.col("region") == 0, F.col(c).cast("double")))
    one = detections.groupBy("frame_id").agg(F.max("image_score").alias("image_score"), F.count("region").cast("double").alias("region_count"), *[first(c).alias(f"r_{c}") for c in REGION.values()])
    one = one.withColumns({"map_max": F.col("image_score"), "grid_h": F.lit(float(grid[0])), "grid_w": F.lit(float(grid[1])), "latency_ns": F.lit(0.0) if latency_ns is None else F.col(latency_ns).cast("double")})
    named = {k: F.col(c) for k, c in DETECTION.items()} | {f"detection.region.0.{k}": F.col(f"r_{c}") for k, c in REGION.items()}
    rows = F.array(*[F.struct(F.lit(k).alias("key"), c.cast("double").alias("number")) for k, c in named.items()])
    out = one.select("frame_id", F.explode(rows).alias("r")).select("frame_id", "r.*").filter("number is not null")
    return out.select("frame_id", "key", "number", F.lit(None).cast("string").alias("text"), F.lit("Direct").alias("source"))


def build_facts(detections: DataFrame, surfaces: DataFrame, grid: tuple[int, int], nodes: DataFrame | None = None, edges: DataFrame | None = None, paths: list[str] = ()) -> DataFrame:
    """Facts of each frame: surface.id (of ``surfaces``: frame_id, surface_id), its detection, and the graph's paths; a bad path is an error."""
    named = surfaces.select("frame_id", F.lit("surface.id").alias("key"), F.lit(None).cast("double").alias("number"), F.col("surface_id").cast("string").alias("text"), F.lit("Direct").alias("source"))
    out = detection_facts(detections, grid).unionByName(named)
    for path in paths:
        value = resolve_path(nodes, edges, path).select(F.col("fact").alias("key"), F.lit(None).cast("double").alias("number"), F.col("value").alias("text"), F.lit("GraphPath").alias("source"))
        out = out.unionByName(surfaces.select("frame_id").crossJoin(F.broadcast(value)).select(*COLUMNS))  # one row
    return out
