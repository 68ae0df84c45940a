"""Helpers that all corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package

#: Rows in one Arrow batch. Texts can be long, so a batch is kept to a few MB.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that long texts fit in a Python worker; let workers import this package.

    The bound is the same for all operators, since plans that were built earlier take it on as well.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Batches of short rows, put together to about ``rows`` of them."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting (a test) gets a folder of its own; a cluster has to name one.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="veriflux-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, computed once and read from the shared folder from then on, whoever is lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fresh_folder(spark: SparkSession, kind: str) -> str:
    """A new, empty folder (URI) in the shared folder, for files that tasks write."""
    uri = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    fs, path = filesystem(uri)
    fs.create_dir(path, recursive=True)
    return uri


def filesystem(uri: str):
    """The pyarrow file system of a URI, and the path in it. Hadoop writes ``file:/x`` for ``file:///x``."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def local_rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A few rows of the driver's, one to a partition (as many as 4096)."""
    df = spark.createDataFrame(rows, schema)
    return df.repartition(min(4096, max(1, len(rows))))
