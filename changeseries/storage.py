"""Stored intermediate tables for jobs that read their input many times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Scratch folders of each application, by its id.
_scratch: dict[str, list[str]] = {}


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session, whose executors share the driver's disk, gets a
    temporary folder when none is named.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="changeseries-")
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, to be removed by ``remove_scratch``."""
    path = f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove_scratch(spark: SparkSession) -> int:
    """Remove the application's scratch folders, once nothing reads results that come from them.

    Returns how many there were. Folders that were named by the caller, results and rounds of a fit, are not touched.
    """
    paths = _scratch.pop(spark.sparkContext.applicationId, [])
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(hadoop).delete(place, True)
    return len(paths)


def lasting_folder(spark: SparkSession) -> str:
    """Where applications that follow each other find what one has left: ``spark.checkpoint.dir`` itself."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return checkpoint_folder(spark) if folder is None else folder.rstrip("/")


def stored(rows: DataFrame, spread: bool = False) -> DataFrame:
    """Compute ``rows`` once and read them from shared storage from then on.

    A lost executor then costs a re-read of its part, not a new scan of the log.
    With ``spread``, for work that is heavy per row, the rows are dealt out by their
    name to the session's number of shuffle partitions, always in the same way.
    """
    spark = rows.sparkSession
    checkpoint_folder(spark)
    if spread:
        rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "name")
    return rows.checkpoint()
