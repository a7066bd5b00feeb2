"""Resumable ingest: a stream of files, encoded, written in one folder for each micro-batch.

The checkpoint holds which files were read; a batch that failed is read again and overwrites its own folder, a finished
one is never touched, and a run without new files does nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import same_geometry


def ingest(spark: SparkSession, source: str, schema: str, out: str, transform: Callable[[DataFrame], DataFrame], geometry: dict | None = None, kind: str = "parquet", files_per_batch: int = 1) -> None:
    """Reads what is new at source, and returns when all of it is written to out/data/batch=N."""
    same_geometry(spark, out, {"schema": schema, **(geometry or {})})
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(source)

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/data/batch={number}")

    query = rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
    query.awaitTermination()


def ingested(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/data")
