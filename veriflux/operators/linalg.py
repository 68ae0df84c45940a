"""Coresets, PCA and whitening: distributed sums, small matrices on the driver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .knn import MAX_QUERIES, _matrix


def greedy_indices(x: np.ndarray, n: int, first: int = 0) -> np.ndarray:
    """Furthest-point selection: starts with row ``first``; ties go to the lower row."""
    n = min(n, len(x))
    out, least = [], np.full(len(x), np.inf)
    for _ in range(n):
        i = first if not out else int(least.argmax())
        out.append(i)
        diff = x - x[i]
        least = np.minimum(least, (diff * diff).sum(axis=1))
        least[i] = -1.0
    return np.array(out, np.int64)


def greedy_coreset(bank: DataFrame, n: int, key: str, max_rows: int = 50_000) -> DataFrame:
    """Of each key's vectors the ``n`` that furthest-point selection takes, in its order: key, vec_id, pick.

    Selection is sequential, so a key of more than ``max_rows`` is selected from in parts
    of that size, and then from what the parts gave (a coreset of coresets, which may differ
    from the selection of all; ``exact_coreset`` makes that one for a bank of any size).
    """
    ship_package(bank.sparkSession)
    kind = dict(bank.dtypes)[key]
    schema = f"{key} {kind}, vec_id long, embedding array<float>, pick int"

    def select(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", ignore_index=True)
        picks = greedy_indices(np.stack(pdf["embedding"].to_numpy()).astype(np.float64), n)
        return pdf.iloc[picks].assign(pick=np.arange(len(picks)))[[key, "vec_id", "embedding", "pick"]]

    sizes = bank.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    parts = F.ceil(F.col("_n") / max_rows).cast("int")
    dealt = bank.join(sizes, key).withColumn("_part", F.pmod(F.xxhash64("vec_id"), parts).cast("int"))
    once = dealt.select(key, "vec_id", "embedding", "_part").groupBy(key, "_part").applyInPandas(lambda pdf: select(pdf.drop(columns="_part")), schema)
    return once.groupBy(key).applyInPandas(lambda pdf: select(pdf.drop(columns="pick")), schema).drop("embedding")


def exact_coreset(bank: DataFrame, n: int) -> DataFrame:
    """The ``n`` vectors of a bank of any size that furthest-point selection takes: vec_id, pick. One pass over the bank a pick.

    Each task holds the picks so far and one batch, and sends its furthest vector; ``greedy_coreset`` makes the same picks of a key that fits in one task.
    """
    ship_package(bank.sparkSession)
    rows = bank.select("vec_id", "embedding")
    first = rows.orderBy("vec_id").limit(1).collect()
    ids, chosen = [r.vec_id for r in first], [np.array(r.embedding, float) for r in first]

    def furthest(known: list[int], c: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = None
            for batch in batches:
                own, x = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1))
                for at in range(0, len(x), 4096):
                    part, names = x[at : at + 4096], own[at : at + 4096]
                    least = np.full(len(part), np.inf)
                    for v in c:
                        least = np.minimum(least, ((part - v) ** 2).sum(axis=1))
                    least[np.isin(names, known)] = -1.0
                    far = np.lexsort((names, -least))[0]
                    if best is None or (-least[far], names[far]) < best[:2]:
                        best = (-least[far], names[far], part[far])
            if best is not None and best[0] <= 0:
                yield pa.RecordBatch.from_arrays([pa.array([-best[0]]), pa.array([int(best[1])]), pa.array([best[2].tolist()], pa.list_(pa.float64()))], ["d2", "vec_id", "embedding"])

        return run

    while ids and len(ids) < n:
        found = rows.mapInArrow(furthest(ids, np.array(chosen)), "d2 double, vec_id long, embedding array<double>").orderBy(F.desc("d2"), "vec_id").limit(1).collect()
        if not found:
            break
        ids.append(found[0].vec_id)
        chosen.append(np.array(found[0].embedding))
    return bank.sparkSession.createDataFrame([(v, i) for i, v in enumerate(ids)], "vec_id long, pick int")


def least_distances(bank: DataFrame, core: DataFrame, most: int = MAX_QUERIES) -> DataFrame:
    """Of each vector of ``bank`` the squared distance to the nearest of ``core``, of ``most`` vectors at most: vec_id, d2."""
    ship_package(bank.sparkSession)
    rows = core.select("vec_id", "embedding").limit(most + 1).toArrow()
    if rows.num_rows > most:
        raise ValueError(f"a coreset of more than {most} vectors")
    c = _matrix(rows.column("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _matrix(part.column(1))
                near = ((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(((x - c[near]) ** 2).sum(axis=1))], ["vec_id", "d2"])

    return bank.select("vec_id", "embedding").mapInArrow(run, "vec_id long, d2 double")


def coverage(bank: DataFrame, coreset: DataFrame) -> DataFrame:
    """Least, mean and largest distance of a bank's vectors to its (bounded) coreset (vec_id). One pass, no pairs."""
    found = least_distances(bank, bank.join(coreset.select("vec_id"), "vec_id", "left_semi")).select(F.sqrt("d2").alias("d"))
    return found.agg(F.min("d").alias("least"), F.avg("d").alias("mean"), F.max("d").alias("largest"))


@dataclass
class Pca:
    mean: np.ndarray
    components: np.ndarray  # a row each
    eigenvalues: np.ndarray

    def to_df(self, spark) -> DataFrame:
        return spark.createDataFrame([(self.mean.tolist(), self.components.tolist(), self.eigenvalues.tolist())], "mean array<double>, components array<array<double>>, eigenvalues array<double>")

    @classmethod
    def from_df(cls, df: DataFrame) -> Pca:
        r = df.first()
        return cls(np.array(r.mean), np.array(r.components), np.array(r.eigenvalues))


def moments(bank: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and scatter matrix: each task sends one small matrix of its part, combined as Chan et al. do."""
    ship_package(bank.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, scatter = 0, 0.0, 0.0
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                n, mean, scatter = _joined((n, mean, scatter), (len(x), x.mean(axis=0), (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tobytes()]), pa.array([scatter.tobytes()])], ["n", "mean", "scatter"])

    out = (0, 0.0, 0.0)
    for r in bank.select("embedding").mapInArrow(run, "n long, mean binary, scatter binary").toLocalIterator():
        mean = np.frombuffer(r.mean)
        out = _joined(out, (r.n, mean, np.frombuffer(r.scatter).reshape(len(mean), -1)))
    return out


def _joined(a, b):
    n = a[0] + b[0]
    delta = b[1] - a[1]
    return n, a[1] + delta * (b[0] / n), a[2] + b[2] + np.outer(delta * np.ones_like(b[1]), delta * np.ones_like(b[1])) * (a[0] * b[0] / n)


def fit_pca(bank: DataFrame, k: int, ddof: int = 0) -> Pca:
    """The ``k`` leading components of the covariance (divided by N - ddof); the largest entry of each is positive."""
    n, mean, scatter = moments(bank)
    if n <= ddof or k > len(mean):
        raise ValueError("more components than dimensions, or too few vectors")
    values, vectors = np.linalg.eigh(scatter / (n - ddof))
    order = np.argsort(-values)[:k]
    c = vectors[:, order].T
    c *= np.sign(c[np.arange(len(c)), np.abs(c).argmax(axis=1)])[:, None]
    return Pca(mean, c, np.maximum(values[order], 0))


def fit_whitening(bank: DataFrame, k: int) -> np.ndarray:
    """Rows: components by the root of their variance; 0 where there is none."""
    p = fit_pca(bank, k)
    return np.where(p.eigenvalues[:, None] > 1e-12, p.components / np.sqrt(np.maximum(p.eigenvalues, 1e-12))[:, None], 0)


def whitened_bank(bank: DataFrame, drop_k: int = 0, k: int | None = None) -> tuple[np.ndarray, DataFrame]:
    """The matrix of the components after the first ``drop_k``, by the root of their variance, and the bank under it (not centred)."""
    dim = len(bank.select("embedding").first().embedding)
    kept = min(dim - drop_k, dim if k is None else k)
    if kept < 1:
        raise ValueError("no component is left")
    p = fit_pca(bank, drop_k + kept)
    matrix = p.components[drop_k:] / np.sqrt(p.eigenvalues[drop_k:, None] + 1e-6)
    return matrix, project(bank, matrix)


def project(bank: DataFrame, matrix: np.ndarray, mean: np.ndarray | None = None) -> DataFrame:
    """vec_id, embedding: the matrix times each vector (less ``mean``, if given). The matrix is small and goes with the tasks."""
    ship_package(bank.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                y = (x - (0 if mean is None else mean)) @ matrix.T
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1]), pa.int32()), pa.array(y.ravel()))], ["vec_id", "embedding"])

    return bank.select("vec_id", "embedding").mapInArrow(run, "vec_id long, embedding array<double>")
