"""Statistics of vector banks: sampling, pooling, scores, normality, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import at_rank, dot
from ..session import written
from .knn import knn


def numbered(df: DataFrame, by: str) -> DataFrame:
    """``df`` with ``_index``, its rows' number from 0 in order of ``by``.

    Ranges are counted first, so that no task sorts all rows. They are written once: worked out twice, Spark
    would cut and coalesce them by the columns that are read, and the counts would be of other ranges.
    """
    ranged = written(df.repartitionByRange(by).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))  # a row for each partition
    local = F.row_number().over(Window.partitionBy("_part").orderBy(by)) - 1
    return ranged.withColumn("_local", local).join(F.broadcast(before.select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))), "_part").withColumn("_index", F.col("_before") + F.col("_local")).drop("_part", "_before", "_local")


def stride_sample(df: DataFrame, n: int, by: str) -> DataFrame:
    """Every floor(N / n)-th row, n of them; all if there are no more."""
    total = df.count()
    if total <= n:
        return df
    stride = total // n
    return numbered(df, by).filter((F.col("_index") % stride == 0) & (F.col("_index") < stride * n)).drop("_index")


def pooled(df: DataFrame, key: str, how: str = "avg", vector: str = "embedding") -> DataFrame:
    """The average or maximum of each dimension in each group: key, pos, value."""
    f = {"avg": F.avg, "max": F.max}[how]
    return df.select(key, F.posexplode(vector).alias("pos", "x")).groupBy(key, "pos").agg(f(F.col("x").cast("double")).alias("value"))


def rank_pick(df: DataFrame, value: str, p: float, keys: list[str] = ()) -> DataFrame:
    """The value at index floor(p (n - 1)) of each group's sorted values."""
    if not keys:
        total = df.agg(F.count(F.lit(1)).alias("_n"))
        rows = numbered(df.select(value), value).crossJoin(F.broadcast(total))  # one row
        return rows.filter(F.col("_index") == at_rank(p, "_n")).select(value)
    w, n = Window.partitionBy(*keys).orderBy(value), F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rows = df.select(*keys, value, (F.row_number().over(w) - 1).alias("_i"), at_rank(p, n).alias("_at"))
    return rows.filter("_i = _at").select(*keys, value)


def pca_scores(vector: Column, mean: list[float], components: list[list[float]], eigenvalues: list[float], drop_k: int = 0) -> dict[str, Column]:
    """Reconstruction error, Mahalanobis, Euclidean and cosine scores; all 0 if nothing is left of the components."""
    if drop_k >= len(components):
        return {k: F.lit(0.0) for k in ("reconstruction", "mahalanobis", "euclidean", "cosine")}
    lits = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    x = F.zip_with(vector, lits(mean), lambda a, m: a.cast("double") - m)
    kept = list(zip(components, eigenvalues))[drop_k:]
    z = [dot(x, lits(c)) for c, _ in kept]
    square = sum((a * a for a in z), F.lit(0.0))
    maha = sum((a * a / (e + 1e-6) for a, (_, e) in zip(z, kept)), F.lit(0.0))
    raw = F.transform(vector, lambda a: a.cast("double"))
    times = lambda a: lambda v: v * a  # noqa: E731  (a lambda of two arguments would get the index)
    recon = lits(mean)
    for a, (c, _) in zip(z, kept):
        recon = F.zip_with(recon, F.transform(lits(c), times(a)), lambda p, q: p + q)
    cosine = 1.0 - dot(raw, recon) / F.greatest(F.sqrt(dot(raw, raw)) * F.sqrt(dot(recon, recon)), F.lit(1e-8))
    return {"reconstruction": F.greatest(F.lit(0.0), dot(x, x) - square), "mahalanobis": maha, "euclidean": square, "cosine": cosine}


def kth_distances(bank: DataFrame, k: int) -> DataFrame:
    """Of each vector its squared distance to the k-th nearest other: vec_id, d2."""
    found = knn(bank.select("vec_id", "embedding"), bank, k, exclude_self=True)
    return found.groupBy(F.col("query_id").alias("vec_id")).agg(F.max("d2").alias("d2"))


def adaptive_threshold(distances: DataFrame, fpr: float = 0.01) -> DataFrame:
    """threshold (at floor((1 - fpr)(N - 1))), reference (the maximum), effective (their ratio)."""
    top = distances.agg(F.max("d2").alias("reference"))
    return rank_pick(distances, "d2", 1 - fpr).select(F.col("d2").alias("threshold")).crossJoin(F.broadcast(top)).withColumn("effective", F.try_divide("threshold", "reference"))  # one row


def normality_profile(distances: DataFrame, tail_max: float = 0.10) -> DataFrame:
    """p50, p95, p99, mean, stddev (population), self_normalcy of a bank's own distances; one row."""
    total = distances.agg(F.count(F.lit(1)).alias("n"))
    rows = numbered(distances.select("d2"), "d2").withColumnRenamed("_index", "i").crossJoin(F.broadcast(total))  # one row
    pick = lambda p: F.max(F.when(F.col("i") == at_rank(p, "n"), F.col("d2")))
    out = rows.agg(pick(0.5).alias("p50"), pick(0.95).alias("p95"), pick(0.99).alias("p99"), F.avg("d2").alias("mean"), F.stddev_pop("d2").alias("stddev"))
    tail = distances.crossJoin(F.broadcast(out.select("p95"))).agg(F.avg((F.col("d2") > F.col("p95")).cast("double")).alias("tail"))  # one row
    return out.crossJoin(F.broadcast(tail)).withColumn("self_normalcy", 1 - F.least(F.lit(1.0), F.col("tail") / tail_max)).drop("tail")


def gates(self_normalcy: Column) -> tuple[Column, Column]:
    """Thresholds of consensus and evolution."""
    return F.when(self_normalcy <= 0, 0.40).otherwise(0.8 * self_normalcy), F.when(self_normalcy <= 0, 0.30).otherwise(0.7 * self_normalcy)


def frame_normalcy(distances: DataFrame, frame: str, p50: float, p95: float, tail_max: float = 0.10, covered: float = 0.60) -> DataFrame:
    """Of each frame's patches: concentration (upper median by p50), tail, normalcy, coverage, novel."""
    n = F.count(F.lit(1)).over(Window.partitionBy(frame))
    rows = distances.select(frame, "d2", (F.row_number().over(Window.partitionBy(frame).orderBy("d2")) - 1).alias("i"), F.floor(n / 2).alias("mid"))
    out = rows.groupBy(frame).agg((F.max(F.when(F.col("i") == F.col("mid"), F.col("d2"))) / p50).alias("concentration"), F.avg((F.col("d2") > p95).cast("double")).alias("tail"), F.avg((F.col("d2") < p50).cast("double")).alias("coverage"))
    return out.withColumn("normalcy", 1 - F.least(F.lit(1.0), F.col("tail") / tail_max)).withColumn("novel", F.col("coverage") < covered)


def consensus(normalcy: Column, detection: Column, n_rules: Column, verdict: Column, effective: float, normal: float, pca: Column | None = None, pca_p95: float = 0.0) -> Column:
    """Whether all signals call a frame normal; the PCA score counts if it has a reference."""
    out = (normalcy >= normal) & (detection < effective) & (n_rules == 0) & (verdict == "OK")
    return out & (pca <= pca_p95) if pca is not None and pca_p95 > 0 else out


def drift(df: DataFrame, key: list[str], by: str, value: str, window: int = 5, last: int = 3, sigmas: float = 2.0) -> DataFrame:
    """``drift`` where the last values all exceed the mean plus ``sigmas`` deviations of the window before them."""
    order = Window.partitionBy(*key).orderBy(by)
    before = order.rowsBetween(-(window + last - 1), -last)
    out = df.withColumns({"base_mean": F.avg(value).over(before), "base_std": F.stddev_pop(value).over(before), "_n": F.count(value).over(before), "_least": F.min(value).over(order.rowsBetween(-(last - 1), 0))})
    return out.withColumn("drift", (F.col("_n") == window) & (F.col("_least") > F.col("base_mean") + sigmas * F.col("base_std"))).drop("_n", "_least")
