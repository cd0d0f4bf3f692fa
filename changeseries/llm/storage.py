"""Tables written to the shared folder between steps."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from changeseries.storage import scratch_path


def shared_path(rows_or_session, name: str) -> str:
    """A new path in the folder that all executors share; ``changeseries.storage.remove_scratch`` removes it."""
    return scratch_path(getattr(rows_or_session, "sparkSession", rows_or_session), name)


def written(rows: DataFrame, name: str) -> DataFrame:
    """Write ``rows`` as Parquet once and read them from there; column-wise, so smaller than a checkpoint."""
    path = shared_path(rows, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)  # the schema is known, so no job looks for it


def release(spark: SparkSession) -> None:
    """Let executors drop the shuffle files of steps whose results are written and that nothing refers to any more.

    Spark does so when the driver collects its garbage, which a job of a few large steps gives it little reason to.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
