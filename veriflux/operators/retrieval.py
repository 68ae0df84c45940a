"""Metadata filters and score fusion."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .knn import knn
from .stats import numbered

_NAME = re.compile(r"[a-zA-Z_]\w*\Z")


def condition(field: str, op: str, value, props: str = "properties") -> Column:
    """A predicate on a JSON property; LIKE ignores the case of letters; IN takes a list or one value."""
    if not _NAME.match(field):
        raise ValueError(f"not a property's name: {field!r}")
    text = F.get_json_object(F.col(props), f"$.{field}")
    one = value[0] if isinstance(value, (list, tuple)) and value else value
    x = text.cast("double") if isinstance(one, (int, float)) and not isinstance(one, bool) else text
    if op.upper() == "IN":
        return x.isin([float(v) if isinstance(v, int) else v for v in (value if isinstance(value, (list, tuple)) else [value])])
    if op.upper() == "LIKE":
        return text.ilike(value)
    ops = {"=": x == value, "!=": x != value, "<": x < value, ">": x > value, "<=": x <= value, ">=": x >= value}
    if op not in ops:
        raise ValueError(f"no such operator: {op!r}")
    return ops[op]


def metadata_search(nodes: DataFrame, filters: list[tuple] = (), types: list[str] = (), limit: int | None = 100) -> DataFrame:
    """Nodes (id, type, properties) of the types that meet all filters, the first ``limit`` by id (None: all): node_id, score (1)."""
    out = nodes.filter(F.col("type").isin(list(types))) if types else nodes
    for f in filters:
        out = out.filter(condition(*f))
    out = out if limit is None else out.orderBy("id").limit(limit)
    return out.select(F.col("id").alias("node_id"), F.lit(1.0).alias("score"))


def _checked(alpha: float) -> float:
    if not 0 <= alpha <= 1:
        raise ValueError("alpha is between 0 and 1")
    return alpha


def fuse_weighted(vector: DataFrame, metadata: DataFrame, alpha: float = 0.5) -> DataFrame:
    """alpha (1 - d / (max(1, largest d) + 1e-6)) + (1 - alpha) m of each node in either; joined by node_id.

    ``vector``: node_id, distance; ``metadata``: node_id, score.
    """
    alpha = _checked(alpha)
    top = vector.agg(F.greatest(F.lit(1.0), F.coalesce(F.max("distance"), F.lit(1.0))).alias("top"))
    scored = vector.crossJoin(F.broadcast(top)).select("node_id", (1 - F.col("distance") / (F.col("top") + 1e-6)).alias("vector_score"))  # one row
    both = scored.join(metadata.select("node_id", F.col("score").alias("metadata_score")), "node_id", "full_outer")
    return both.withColumn("fused", F.coalesce(alpha * F.col("vector_score"), F.lit(0.0)) + F.coalesce((1 - alpha) * F.col("metadata_score"), F.lit(0.0)))


def fuse_rrf(vector: DataFrame, metadata: DataFrame, k: int = 60) -> DataFrame:
    """Sum of 1 / (k + rank), ranks from 1: vector by distance, metadata by node_id."""
    if k <= 0:
        raise ValueError("k is positive")
    a = numbered(vector.select("node_id", F.struct("distance", "node_id").alias("by")), "by").select("node_id", (F.col("_index") + 1).alias("vector_rank"))
    b = numbered(metadata.select("node_id", F.struct((-F.col("score")).alias("s"), "node_id").alias("by")), "by").select("node_id", (F.col("_index") + 1).alias("metadata_rank"))
    share = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return a.join(b, "node_id", "full_outer").withColumn("fused", share("vector_rank") + share("metadata_rank"))


def hybrid(query: DataFrame, bank: DataFrame, bridge: DataFrame, nodes: DataFrame, *, k: int = 10, filters: list[tuple] = (), types: list[str] = (), limit: int | None = 100, alpha: float = 0.5, method: str = "weighted") -> DataFrame:
    """Metadata first; its nodes' vectors (``bridge``: vec_id, node_id) restrict the vector search; then fusion.

    With filters that nothing meets the result is empty.
    """
    hits = metadata_search(nodes, filters, types, limit)
    subset = bridge.join(hits, "node_id", "left_semi") if filters or types else None
    found = knn(query, bank, k, subset=subset)
    vector = found.join(bridge, "vec_id").groupBy("node_id").agg(F.min("d2").alias("distance"))
    if subset is not None:
        vector = vector.join(hits.select("node_id"), "node_id", "left_semi")
    return fuse_weighted(vector, hits, alpha) if method == "weighted" else fuse_rrf(vector, hits)
