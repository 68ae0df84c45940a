"""Sessions, and the package's way to the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let executors import this package, wherever the driver has it from. Once an application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    fd, name = tempfile.mkstemp(prefix="veriflux-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(name)
    _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder's name in the one that the driver and all executors share, ``spark.checkpoint.dir``; a local session may do without that setting."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="veriflux-shared-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return f"{found.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str = "walk") -> DataFrame:
    """``df`` as a table in the shared folder, worked out once; what reads it knows its size."""
    at = shared_folder(df.sparkSession, kind)
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def get_session(app_name: str = "veriflux", **conf: str) -> SparkSession:
    """A session with what the engine relies on: UTC, adaptive plans with split joins, Arrow."""
    builder = SparkSession.builder.appName(app_name)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
