"""Vector and scalar functions as columns: JVM only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a, b) -> Column:
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a, b) -> Column:
    """Squared Euclidean distance, added up in double in the arrays' order."""
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def l2_normalised(v, least: float = 1e-12) -> Column:
    """v by its length; vectors of squared length up to ``least`` stay as they are."""
    v = _col(v)
    square = dot(v, v)
    return F.when(square > least, F.transform(v, lambda x: x.cast("double") / F.sqrt(square))).otherwise(F.transform(v, lambda x: x.cast("double")))


def sigmoid(x) -> Column:
    return 1.0 / (1.0 + F.exp(-_col(x)))


def at_rank(p: float, n) -> Column:
    """0-based index of the p-quantile among n sorted values: floor(p (n - 1)), never interpolated."""
    return F.floor(F.lit(p) * (_col(n) - 1) + F.lit(1e-9)).cast("int")
