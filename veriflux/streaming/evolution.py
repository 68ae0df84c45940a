"""Online evolution of a vector bank: novelty, a candidate buffer, and versioned updates.

The stream writes candidates micro-batch by micro-batch, keyed by the batch's id, so a
replayed batch overwrites its own rows. An update merges candidates with the bank into a
new version; readers take the highest whole version.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.knn import knn
from ..operators.linalg import greedy_coreset
from ..operators.stats import consensus, gates, kth_distances, normality_profile, stride_sample


@dataclass
class EvolutionConfig:
    k: int = 5
    target: int = 10_000
    prefilter: int = 5_000
    max_frames: int = 50
    max_patches: int = 50_000
    trigger_frames: int = 20
    trigger_patches: int = 20_000
    least_coverage_share: float = 0.8


    normality_k: int = 5
    tail_ratio_max: float = 0.10
    coverage_threshold: float = 0.60
    saturation_coverage: float = 0.95
    saturation_window: int = 10
    enabled: bool = True


def config_from_yaml(text: str) -> EvolutionConfig:
    """The section self_evolution of a file; what it leaves out has its default, and without the section evolution is off."""
    import yaml

    doc = (yaml.safe_load(text) or {}).get("self_evolution")
    if doc is None:
        return EvolutionConfig(enabled=False)
    if not isinstance(doc, dict):
        raise ValueError("self_evolution is a map")
    part = lambda name: doc.get(name) or {}
    found = {"normality_k": part("normality").get("k_self_query"), "tail_ratio_max": part("normality").get("tail_ratio_max"), "coverage_threshold": part("novelty").get("coverage_threshold"), "target": part("update").get("target_size"), "prefilter": part("update").get("greedy_prefilter")}
    found |= {k: part("buffer").get(k) for k in ("max_frames", "max_patches", "trigger_frames", "trigger_patches")}
    found |= {"saturation_coverage": part("maintenance").get("coverage_saturation_threshold"), "saturation_window": part("maintenance").get("saturation_window"), "least_coverage_share": part("maintenance").get("validation_degradation_threshold")}
    known = EvolutionConfig(enabled=bool(doc.get("enabled", False)))
    for k, v in found.items():
        if v is not None:
            setattr(known, k, type(getattr(known, k))(v))
    return known


def assessed(frames: DataFrame, profile, effective: float, cfg: EvolutionConfig) -> DataFrame:
    """Of frames (normalcy, coverage, image_score, n_rules, verdict) whether all signals agree, whether each is new, and whether it is offered."""
    normal, _ = gates(F.lit(profile.self_normalcy))
    agreed = consensus(F.col("normalcy"), F.col("image_score"), F.col("n_rules"), F.col("verdict"), effective, normal)
    novel = F.col("coverage") < cfg.coverage_threshold
    return frames.withColumns({"agreed": agreed, "novel": novel, "offered": agreed & novel})


def saturated(frames: DataFrame, by: str, cfg: EvolutionConfig) -> DataFrame:
    """``paused`` where the last ``saturation_window`` frames are all covered: the bank is mature."""
    w = Window.partitionBy("bank_key").orderBy(by).rowsBetween(-(cfg.saturation_window - 1), 0)
    full = (F.count(F.lit(1)).over(w) == cfg.saturation_window) & (F.min("coverage").over(w) >= cfg.saturation_coverage)
    return frames.withColumn("paused", full)


def rebuild(bank: DataFrame, candidates: DataFrame, cfg: EvolutionConfig, folder: str) -> dict:
    """A new bank from all of ``bank`` and ``candidates``, written to ``folder`` with its profile; the old one is kept beside it as backup.

    Returns the new profile, and displacement: how far the mean self-distance moved.
    """
    spark = bank.sparkSession
    before = normality_profile(kth_distances(stride_sample(bank, 2000, "vec_id"), cfg.normality_k)).first()
    offset = bank.agg(F.max("vec_id")).first()[0] + 1
    both = bank.select("vec_id", "embedding").unionByName(candidates.select((F.col("vec_id") + offset).alias("vec_id"), "embedding"))
    picked = greedy_coreset(both.withColumn("bank_key", F.lit(0)), cfg.target, "bank_key").select("vec_id")
    both.join(picked, "vec_id", "left_semi").write.mode("overwrite").parquet(f"{folder}/bank")
    bank.select("vec_id", "embedding").write.mode("overwrite").parquet(f"{folder}/backup")
    new = spark.read.parquet(f"{folder}/bank")
    after = normality_profile(kth_distances(stride_sample(new, 2000, "vec_id"), cfg.normality_k))
    after.write.mode("overwrite").parquet(f"{folder}/profile")
    profile = spark.read.parquet(f"{folder}/profile").first()
    return profile.asDict() | {"displacement": abs(profile.mean - before.mean), "vectors": new.count()}


def offer(patches: DataFrame, bank: DataFrame, profile, frame: str = "frame_id") -> DataFrame:
    """Of a micro-batch (frame, vec_id, embedding) the patches of frames that look normal yet new: novel and over the consensus gate."""
    from ..operators.stats import frame_normalcy

    found = knn(patches.select("vec_id", "embedding"), bank, 1).select(F.col("query_id").alias("vec_id"), "d2")
    scored = frame_normalcy(patches.select(frame, "vec_id").join(found, "vec_id"), frame, profile.p50, profile.p95)
    normal, _ = gates(F.lit(profile.self_normalcy))
    good = scored.filter(F.col("novel") & (F.col("normalcy") >= normal)).select(frame, "normalcy")
    return patches.join(good, frame)


def buffered(candidates: DataFrame, cfg: EvolutionConfig, frame: str = "frame_id") -> DataFrame:
    """What the buffer accepts: frames in order of arrival up to its limits of frames and patches."""
    sizes = candidates.groupBy("batch_id", frame).agg(F.count(F.lit(1)).alias("n"))
    batches = sizes.groupBy("batch_id").agg(F.count(F.lit(1)).alias("f"), F.sum("n").alias("p"))
    earlier = Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1)  # a row for each batch
    before = batches.select("batch_id", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"before_{c}") for c in "fp"])
    own = Window.partitionBy("batch_id").orderBy(frame)
    kept = sizes.withColumns({"frames": F.row_number().over(own), "patches": F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, 0))}).join(before, "batch_id")
    kept = kept.withColumns({"frames": F.col("frames") + F.col("before_f"), "patches": F.col("patches") + F.col("before_p")})
    return candidates.join(kept.filter((F.col("frames") <= cfg.max_frames) & (F.col("patches") <= cfg.max_patches)).select("batch_id", frame), ["batch_id", frame])


def triggered(candidates: DataFrame, cfg: EvolutionConfig, frame: str = "frame_id") -> bool:
    r = candidates.agg(F.count_distinct(frame).alias("frames"), F.count(F.lit(1)).alias("patches")).first()
    return r.frames >= cfg.trigger_frames or r.patches >= cfg.trigger_patches


def covered(bank: DataFrame, old: DataFrame, p50: float) -> float:
    """Share of a sample of the old bank that lies within ``p50`` of the new one."""
    sample = stride_sample(old, 1000, "vec_id")
    return knn(sample.select("vec_id", "embedding"), bank, 1).agg(F.avg((F.col("d2") < p50).cast("double"))).first()[0] or 0.0


def update(bank: DataFrame, candidates: DataFrame, cfg: EvolutionConfig) -> tuple[DataFrame, bool]:
    """The next version of a bank (vec_id, embedding), and whether it is new: a version that forgets too much of the old one is turned down."""
    profile = normality_profile(kth_distances(stride_sample(bank, 2000, "vec_id"), cfg.k)).first()
    offset = bank.agg(F.max("vec_id")).first()[0] + 1
    new = stride_sample(candidates.select("vec_id", "embedding"), cfg.prefilter, "vec_id")
    both = bank.select("vec_id", "embedding").unionByName(new.select((F.col("vec_id") + offset).alias("vec_id"), "embedding"))
    picked = greedy_coreset(both.withColumn("bank_key", F.lit(0)), cfg.target, "bank_key").select("vec_id")
    version = both.join(picked, "vec_id", "left_semi")
    if covered(version, bank, profile.p50) < cfg.least_coverage_share * covered(bank, bank, profile.p50):
        return bank, False
    return version, True


def start(stream: DataFrame, bank: DataFrame, profile, folder: str, checkpoint: str, frame: str = "frame_id"):
    """Run ``offer`` on a stream of patches; candidates go to ``folder``/batch_id=N."""

    def each(batch: DataFrame, batch_id: int) -> None:
        offer(batch, bank, profile, frame).write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)
