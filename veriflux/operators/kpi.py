"""Quality indicators: PPM, trend, defect shares, confusion, costs, latencies, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def ppm(frames: DataFrame, *keys: str) -> DataFrame:
    """Verdicts counted, and defects (all but OK) a million."""
    count = lambda v: F.count_if(F.col("verdict") == v)
    out = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *[count(v).alias(v.lower()) for v in ("OK", "NG", "WARN", "UNCERTAIN")])
    return out.withColumn("ppm", F.round(1e6 * share(F.col("ng") + F.col("warn") + F.col("uncertain"), F.col("total")), 4))


def ppm_trend(frames: DataFrame, by: str, last: int = 1000) -> DataFrame:
    """Running NG a million of OK and NG over the last ``last`` frames."""
    recent = frames.orderBy(F.desc(by)).limit(last)
    w = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    ng, ok = (F.count_if(F.col("verdict") == v).over(w) for v in ("NG", "OK"))
    return recent.select(by, F.round(1e6 * share(ng, ng + ok), 4).alias("ppm"))


def defect_share(frames: DataFrame, defects: str = "triggered") -> DataFrame:
    """Of each defect type its count, and its percentage of all frames."""
    total = frames.agg(F.count(F.lit(1)).alias("frames"))
    counted = frames.select(F.explode(defects).alias("defect")).groupBy("defect").agg(F.count(F.lit(1)).alias("n"))
    return counted.crossJoin(F.broadcast(total)).select("defect", "n", F.round(100 * share(F.col("n"), F.col("frames")), 6).alias("percent"))  # one row


def confusion(df: DataFrame, *keys: str) -> DataFrame:
    """Of verdict against expected (OK is positive; others than OK and NG don't count): counts, precision, recall, f1, accuracy."""
    is_ = lambda v, e: F.count_if((F.col("verdict") == v) & (F.col("expected") == e))
    out = df.groupBy(*keys).agg(is_("OK", "OK").alias("tp"), is_("NG", "NG").alias("tn"), is_("OK", "NG").alias("fp"), is_("NG", "OK").alias("fn"))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    p, r = share(tp, tp + fp), share(tp, tp + fn)
    return out.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6), "accuracy": F.round(share(tp + tn, tp + tn + fp + fn), 6)})


def worst_verdict(frames: DataFrame, key: str = "surface_id") -> DataFrame:
    """Of each surface the worst verdict (NG, WARN, UNCERTAIN, OK) and its number of frames."""
    rank = F.when(F.col("verdict") == "NG", 3).when(F.col("verdict") == "WARN", 2).when(F.col("verdict") == "UNCERTAIN", 1).otherwise(0)
    return frames.groupBy(key).agg(F.max_by("verdict", rank).alias("worst"), F.count(F.lit(1)).alias("frames"))


def latency(df: DataFrame, key: str, by: str, value: str, ring: int = 100, p: float = 0.99) -> DataFrame:
    """Of each row: p99 (index floor(p n) of the last ``ring`` values) and last."""
    values = F.sort_array(F.collect_list(value).over(Window.partitionBy(key).orderBy(by).rowsBetween(-(ring - 1), 0)))
    at = F.least(F.floor(F.lit(p) * F.size("_ring") + F.lit(1e-9)).cast("int"), F.size("_ring") - 1)
    return df.withColumn("_ring", values).withColumn("p99", F.get("_ring", at)).drop("_ring").withColumn("last", F.col(value))


def severity_bucket(score: Column) -> Column:
    return F.when(score > 0.7, "HIGH").when(score > 0.3, "MEDIUM").otherwise("LOW")


def throughput(df: DataFrame, by: str, processed: str) -> DataFrame:
    """Frames a second between samples (ts, cumulative count)."""
    w = Window.orderBy(by)
    seconds = F.unix_micros(F.col(by).cast("timestamp")) / 1e6
    return df.withColumn("fps", F.try_divide(F.col(processed) - F.lag(processed).over(w), seconds - F.lag(seconds).over(w)))


def in_flight(stages: DataFrame) -> DataFrame:
    """What is still under way: processed less failed and dropped."""
    return stages.withColumn("in_flight", F.col("processed") - F.col("failed") - F.col("dropped"))


def confusion_cost(truth: DataFrame, fp_cost: float = 1.0, fn_cost: float = 5.0) -> DataFrame:
    """Cost a frame of wrong verdicts (machine_ng against is_ng); 0 of no frames."""
    fp, fn = F.count_if(F.col("machine_ng") & ~F.col("is_ng")), F.count_if(~F.col("machine_ng") & F.col("is_ng"))
    out = truth.agg(F.count(F.lit(1)).alias("total"), fp.alias("fp"), fn.alias("fn"))
    return out.withColumn("cost", F.round(share(fp_cost * F.col("fp") + fn_cost * F.col("fn"), F.col("total")), 6))


def threshold_replay(truth: DataFrame, thresholds: list[float], fp_cost: float = 1.0, fn_cost: float = 5.0) -> DataFrame:
    """The cost at each threshold of the score, all in one pass: conditional counts, no join.

    ``truth``: score (may be null), stored_ng, is_ng.
    """
    aggs = []
    for i, t in enumerate(thresholds):
        ng = F.when(F.col("score").isNotNull(), F.col("score") > t).otherwise(F.col("stored_ng"))
        aggs += [F.count_if(ng & ~F.col("is_ng")).alias(f"fp_{i}"), F.count_if(~ng & F.col("is_ng")).alias(f"fn_{i}")]
    one = truth.agg(F.count(F.lit(1)).alias("total"), *aggs)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"fp_{i}").alias("fp"), F.col(f"fn_{i}").alias("fn")) for i, t in enumerate(thresholds)])
    out = one.select("total", F.explode(rows).alias("r")).select("r.*", "total")
    return out.withColumn("cost", F.round(share(fp_cost * F.col("fp") + fn_cost * F.col("fn"), F.col("total")), 6))


def drop_oldest(df: DataFrame, key: str, by: list[str], capacity: int) -> DataFrame:
    """What a full queue that drops its oldest holds in the end: the last ``capacity`` of each key."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in by]))
    return df.withColumn("_n", n).filter(F.col("_n") <= capacity).drop("_n")


def circuit_breaker(frames: DataFrame, least: int = 50, low: float = 0.001, high: float = 0.5) -> DataFrame:
    out = frames.agg(F.count(F.lit(1)).alias("samples"), share(F.count_if(F.col("verdict") == "NG"), F.count(F.lit(1))).alias("ng_rate"))
    return out.withColumn("rollback", (F.col("samples") >= least) & ~F.col("ng_rate").between(low, high))
