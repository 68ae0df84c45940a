"""A record of inspections, appended micro-batch by micro-batch.

A batch is written under its own id, so one that is replayed overwrites its own rows. A
micro-batch has room for all its rows: there is no buffer that could be full, and none is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "detection_score double, machine_verdict string, surface_id string, timestamp long"


def ground_truth(results: DataFrame) -> DataFrame:
    """Records of ``RECORD``: an empty surface is null, and a time of 0 or null (microseconds) is now."""
    at = F.nullif(F.col("timestamp").cast("long"), F.lit(0).cast("long"))
    return results.select(
        F.col("detection_score").cast("double"),
        F.col("machine_verdict").cast("string"),
        F.nullif(F.col("surface_id").cast("string"), F.lit("")).alias("surface_id"),
        F.coalesce(at, F.unix_micros(F.current_timestamp())).alias("timestamp"),
    )


def record(stream: DataFrame, folder: str, checkpoint: str):
    """Write the records of a stream of results to ``folder``/batch_id=N."""

    def each(batch: DataFrame, batch_id: int) -> None:
        ground_truth(batch).write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recorded(spark: SparkSession, folder: str) -> DataFrame:
    """All records so far, with their ``batch_id``."""
    return spark.read.schema(RECORD + ", batch_id long").parquet(folder)
