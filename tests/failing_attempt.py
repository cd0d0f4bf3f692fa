"""Run by test_stored_stages: a job in which tasks of the last stage fail once, after some rows."""

import tempfile
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeseries.plans.job import run
from changeseries.plans.spec import JobSpec

START = datetime(2024, 1, 1)
calls: list[int] = []  # of this worker process


@F.arrow_udf(T.BooleanType())
def fails_once(values: pa.Array) -> pa.Array:
    task = TaskContext.get()
    calls.append(1)
    if task.attemptNumber() == 0 and task.partitionId() in (1, 2) and len(calls) % 3 == 0:
        raise RuntimeError("a first attempt fails")
    return pa.array([True] * len(values))


spark = (
    SparkSession.builder.master("local[2,3]")
    .config("spark.sql.shuffle.partitions", "4")
    .config("spark.sql.adaptive.enabled", "false")
    .config("spark.ui.enabled", "false")
    .config("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    .getOrCreate()
)
spark.sparkContext.setLogLevel("OFF")
rows = [(f"e{i}", "p", "v", START + timedelta(days=d)) for i in range(200) for d in range(20)]
log = spark.createDataFrame(rows, "entity string, property string, value string, ts timestamp_ntz").repartition(4)
spec = JobSpec(start=START, end=START + timedelta(days=20), granularity=1, clustering_alg="DBAKMeans", k=1, seed=1)
result = run(spark, spec, changes=log, series_filter=fails_once(F.size("y")), write=False)
failures = spark.sparkContext.statusTracker()
stages = [failures.getStageInfo(i) for i in range(200)]
print("failed attempts:", sum(s.numFailedTasks for s in stages if s))
print(result.metrics)
spark.stop()
