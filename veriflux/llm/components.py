"""Connected components of links, kept distributed throughout.

Alternates the large-star and small-star steps of Kiveris et al., "Connected Components in
MapReduce and Beyond" (SoCC 2014). A step takes the least neighbour of each node by a
group-by with partial aggregation and hands it on by a join, whose skewed partitions
Spark splits, so the hub of a star of a third of all nodes isn't one task's work. Lineage
is cut after each round by a checkpoint in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    # a larger neighbour gets the least of u's neighbourhood; u itself is handed on by small stars
    out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges have u > v."""
    least = _least(edges)
    out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node``, ``root`` for each node that isn't its component's least. Nodes are longs; null ends are ignored."""
    links = edges.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).filter("x <> y")
    links = checkpointed(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = tuple(mark(links))
    for _ in range(max_rounds):
        if not before[0]:
            break
        links = checkpointed(_small_star(_large_star(links)))
        now = tuple(mark(links))
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))


def local_components(n: int, a, b):
    """Least member of each of ``n`` nodes' components, by arrays of links; for the few nodes of one task's group."""
    import numpy as np

    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            break
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root
