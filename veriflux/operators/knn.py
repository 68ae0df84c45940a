"""Exact and approximate nearest neighbours.

A query set of up to ``MAX_QUERIES`` vectors is sent to each task in blocks, and each task
keeps the k best of its part of the bank for each query. What is shuffled is k rows a query and
task, whatever the bank's size; the bank itself never moves. The count is checked; more queries
than that go through ``knn_join``, which deals both sides into blocks, with nothing on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package

#: Queries in a block that is sent to each task, and floats in it at most.
BLOCK_QUERIES, BLOCK_FLOATS = 4096, 1 << 24
#: Queries that are sent to all tasks, and vectors of either side in a task of the block join.
MAX_QUERIES, JOIN_BLOCK = 65_536, 8_192
FOUND = "query_id long, vec_id long, d2 double"


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix in double."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def query_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the queries (id, embedding), a block at a time."""
    ids, rows = [], []
    for r in queries.toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) >= BLOCK_QUERIES or len(ids) * len(rows[0]) >= BLOCK_FLOATS:
            yield np.array(ids, np.int64), np.array(rows, np.float64)
            ids, rows = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(rows, np.float64)


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances of rows, added up in order."""
    total = np.zeros(len(q))
    for d in range(q.shape[1]):
        diff = q[:, d] - x[:, d]
        total += diff * diff
    return total


def _nearest(ids: np.ndarray, q: np.ndarray, k: int, exclude_self: bool, most: float | None):
    square = (q * q).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for batch in batches:
            own, x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), _matrix(batch.column(1))
            if not len(x):
                continue
            rough = square[:, None] + (x * x).sum(axis=1)[None, :] - 2 * (q @ x.T)
            if exclude_self:
                rough[ids[:, None] == own[None, :]] = np.inf
            slack = 1e-9 * (1 + square[:, None] + np.abs(rough[np.isfinite(rough)]).max(initial=0))
            if most is not None:
                i, j = np.nonzero(rough <= most + slack)
            else:
                kth = np.partition(rough, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1 : min(k, len(x))]
                i, j = np.nonzero((rough <= kth + slack) & np.isfinite(rough))
            d2 = _exact(q[i], x[j])
            if most is not None:
                keep = d2 < most
                yield pa.RecordBatch.from_arrays([pa.array(ids[i[keep]]), pa.array(own[j[keep]]), pa.array(d2[keep])], ["query_id", "vec_id", "d2"])
                continue
            rows = [np.concatenate(c) for c in zip(best, (i, own[j], d2))]
            order = np.lexsort((rows[1], rows[2], rows[0]))
            rows = [r[order] for r in rows]
            start = np.searchsorted(rows[0], rows[0])
            keep = np.arange(len(start)) - start < k
            best = tuple(r[keep] for r in rows)
        if most is None:
            yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[1]), pa.array(best[2])], ["query_id", "vec_id", "d2"])

    return run


def _search(queries: DataFrame, bank: DataFrame, k: int, exclude_self: bool, most: float | None) -> DataFrame:
    spark = bank.sparkSession
    ship_package(spark)
    out = None
    for ids, q in query_blocks(queries):
        part = bank.mapInArrow(_nearest(ids, q, k, exclude_self, most), FOUND)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], FOUND) if out is None else out


def knn(queries: DataFrame, bank: DataFrame, k: int, exclude_self: bool = False, subset: DataFrame | None = None) -> DataFrame:
    """The k nearest of ``bank`` (vec_id, embedding) to each of ``queries`` (id, embedding): query_id, vec_id, rank, d2.

    ``subset`` (vec_id) restricts the bank before the search; an empty one doesn't. Ties go to the smaller vec_id.
    """
    if k <= 0:
        return queries.sparkSession.createDataFrame([], "query_id long, vec_id long, rank int, d2 double")
    bank = bank.select("vec_id", "embedding")
    if subset is not None and subset.limit(1).count():
        bank = bank.join(subset.select("vec_id"), "vec_id", "left_semi")
    if queries.limit(MAX_QUERIES + 1).count() > MAX_QUERIES:
        key, vector = queries.columns[:2]
        return knn_join(queries.select(F.col(key).alias("query_id"), F.col(vector).alias("embedding")), bank, k, exclude_self=exclude_self)
    return _best(_search(queries, bank, k, exclude_self, None), k)


def _best(found: DataFrame, k: int, *keys: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys, "query_id").orderBy("d2", "vec_id"))
    return found.select(*keys, "query_id", "vec_id", rank.alias("rank"), "d2").filter(F.col("rank") <= k)


def knn_join(queries: DataFrame, bank: DataFrame, k: int, keys: tuple[str, ...] = (), exclude_self: bool = False, block: int = JOIN_BLOCK) -> DataFrame:
    """The k nearest of ``bank`` (keys, vec_id, embedding) to each of ``queries`` (keys, query_id, embedding) with the same keys, of any number.

    Both sides of a key are dealt into blocks of about ``block`` vectors; a task holds one block of each, and gives
    k rows a query. So no key is one task's work, and what is shuffled beside the blocks is k rows a query and block.
    """
    ship_package(bank.sparkSession)
    keys = list(keys)
    q = queries.select(*keys, "query_id", F.col("embedding").alias("q"))
    own = [F.col(c).alias(c) for c in keys]  # both sides may come from one table
    b = bank.select(*own, "vec_id", "embedding")
    blocks = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    sizes = blocks(q, "nq").join(blocks(b, "nb"), keys) if keys else blocks(q, "nq").crossJoin(blocks(b, "nb"))  # one row
    join = lambda df: df.join(sizes, keys) if keys else df.crossJoin(F.broadcast(sizes))  # noqa: E731  one row
    deal = lambda id_, n: F.pmod(F.xxhash64(id_), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = join(q).filter("nq > 0 and nb > 0").select(*keys, deal("query_id", "nq").alias("i"), every("nb").alias("j"), "query_id", "q")
    b = join(b).filter("nq > 0 and nb > 0").select(*own, every("nq").alias("i"), deal("vec_id", "nb").alias("j"), "vec_id", "embedding")
    names, kinds = keys + ["query_id", "vec_id", "d2"], dict(queries.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keys] + [FOUND])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c: left.column(c).slice(0, 0) for c in keys} | {"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "d2": pa.array([], pa.float64())})
        ids, x = left.column("query_id").to_numpy(), _matrix(left.column("q"))
        out = []
        for at in range(0, len(ids), 1024):
            part = pa.RecordBatch.from_arrays([right.column(c).combine_chunks() for c in ("vec_id", "embedding")], ["vec_id", "embedding"])
            out += _nearest(ids[at : at + 1024], x[at : at + 1024], k, exclude_self, None)([part])
        found = pa.Table.from_batches(out)
        return pa.table([pa.chunked_array([pa.array([left.column(c)[0].as_py()] * found.num_rows, left.schema.field(c).type)]) for c in keys] + found.columns, names)

    group = [*keys, "i", "j"]
    return _best(q.groupBy(*group).cogroup(b.groupBy(*group)).applyInArrow(run, schema), k, *keys)


def range_search(queries: DataFrame, bank: DataFrame, radius: float = 1.0, exclude_self: bool = False) -> DataFrame:
    """All of ``bank`` with a squared distance under ``radius``: query_id, vec_id, d2."""
    return _search(queries, bank.select("vec_id", "embedding"), 0, exclude_self, radius)


class IvfIndex:
    """Cells around centroids; a search looks into the ``nprobe`` nearest cells alone.

    Centroids come from a bounded sample (``max_fit``); every vector gets its cell. With ``folder`` the
    index is written there, a folder for each cell, and a search reads the cells alone that it probes;
    without it each search deals the vectors out to cells anew, which is for a single one.
    """

    def __init__(self, bank: DataFrame, nlist: int = 256, max_fit: int = 50_000, rounds: int = 12, folder: str | None = None):
        ship_package(bank.sparkSession)
        sample = bank.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(max_fit).toArrow()
        x = _matrix(sample.column("embedding"))
        nlist = max(1, min(nlist, len(x)))
        c = x[:nlist].copy()
        for _ in range(rounds):
            cell = self._cells(x, c, 1)[:, 0]
            n = np.bincount(cell, minlength=nlist)
            total = np.zeros_like(c)
            np.add.at(total, cell, x)
            c[n > 0] = total[n > 0] / n[n > 0, None]
        self.centroids = c

        def assign(batches):
            for batch in batches:
                cell = self._cells(_matrix(batch.column(1)), c, 1)[:, 0] if batch.num_rows else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int32())], ["vec_id", "embedding", "cell"])

        self.bank = bank.select("vec_id", "embedding").mapInArrow(assign, "vec_id long, embedding array<float>, cell int")
        if folder is not None:
            self.bank.repartition("cell").write.partitionBy("cell").parquet(folder)
            self.bank = bank.sparkSession.read.schema("vec_id long, embedding array<float>, cell int").parquet(folder)

    @staticmethod
    def _cells(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
        return np.argsort((c * c).sum(axis=1)[None, :] - 2 * x @ c.T, axis=1, kind="stable")[:, :n]

    def search(self, queries: DataFrame, k: int, nprobe: int = 4, exclude_self: bool = False) -> DataFrame:
        c, parts = self.centroids, []
        if queries.limit(MAX_QUERIES + 1).count() > MAX_QUERIES:
            raise ValueError(f"more than {MAX_QUERIES} queries at once")
        for ids, q in query_blocks(queries):
            cells = self._cells(q, c, nprobe)
            wanted = {int(v): np.flatnonzero((cells == v).any(axis=1)) for v in np.unique(cells)}

            def run(batches, ids=ids, q=q, wanted=wanted):
                rows = []
                for batch in batches:
                    own, x, cell = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1)), batch.column(2).to_numpy()
                    for v in np.unique(cell):
                        if (i := wanted.get(int(v))) is None:
                            continue
                        inside = np.flatnonzero(cell == v)
                        part = pa.RecordBatch.from_arrays([pa.array(own[inside]), batch.column(1).take(pa.array(inside))], ["vec_id", "embedding"])
                        rows += _nearest(ids[i], q[i], k, exclude_self, None)([part])
                yield from rows

            parts.append(self.bank.filter(F.col("cell").isin([int(v) for v in wanted])).mapInArrow(run, FOUND))
        if not parts:
            return queries.sparkSession.createDataFrame([], "query_id long, vec_id long, rank int, d2 double")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "vec_id"))
        return out.select("query_id", "vec_id", rank.alias("rank"), "d2").filter(F.col("rank") <= k)
