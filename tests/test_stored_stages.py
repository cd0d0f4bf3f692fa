"""One scan for derived bounds, counts that repeated tasks do not change, options of every source, scratch folders."""

import os
import subprocess
import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from changeseries.operators import series
from changeseries.plans import job
from changeseries.plans.job import run
from changeseries.plans.spec import JobSpec
from changeseries.sources import jdbc
from changeseries.sources.changelog import positional_keys
from changeseries.sources.jdbc import Database
from changeseries.storage import remove_scratch, scratch_path

LOG = "entity string, property string, value string, ts timestamp_ntz"
START = datetime(2024, 1, 1)


def changes(spark, entities=6):
    rows = [(f"e{i}", "pq"[i % 2], "v", START + timedelta(days=d, hours=k)) for i in range(entities) for d in range(5) for k in range(1 + i * d % 23)]
    return spark.createDataFrame(rows, LOG).repartition(4), len(rows)


def counting(rows, seen):
    """``rows``, with every row that is read added to the accumulator."""

    def each(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return rows.mapInArrow(each, rows.schema)


@pytest.mark.parametrize("least", [None, 20])
def test_derived_bounds_read_the_source_once(spark, least):
    group_filter = None if least is None else F.col("n") > least
    log, n = changes(spark)
    seen = spark.sparkContext.accumulator(0)
    found, windows = series.derived_series(counting(log, seen), ["entity"], group_filter, 1, "Days")
    rows = {r.name[0]: r.y for r in found.collect()}
    assert seen.value == n
    assert windows == series.derive_windows(log, ["entity"], group_filter, 1, "Days")
    assert rows == {r.name[0]: r.y for r in series.build_series(log, ["entity"], windows, group_filter).collect()}
    with pytest.raises(ValueError, match="no change is left"):
        series.derived_series(log.where("false"), ["entity"], group_filter)


def spec(**more):
    return JobSpec(**{"granularity": 1, "clustering_alg": "DBAKMeans", "k": 2, "seed": 1} | more)


def test_a_job_without_bounds_reads_the_source_once(spark):
    log, n = changes(spark)
    seen = spark.sparkContext.accumulator(0)
    result = run(spark, spec(), changes=counting(log, seen), group_filter=F.col("n") > 10, write=False)
    assert seen.value == n and result.metrics["changes"] == n and result.metrics["series"] == 5
    missing = log.union(spark.createDataFrame([("x", "p", "v", None)], LOG))
    with pytest.raises(Exception, match="no time"):
        run(spark, spec(), changes=missing, write=False)
    assert run(spark, spec(missing_time="drop"), changes=missing, write=False).metrics["changes"] == n


def test_metrics_tell_how_far_groups_came(spark):
    log, n = changes(spark)
    more = spark.createDataFrame([("flat", "p", "v", START + timedelta(days=d)) for d in range(5)], LOG)
    result = run(
        spark, spec(start=START, end=START + timedelta(days=5), transformation=("Normalize",), non_finite="drop"),
        group_filter=F.col("n") > 4, series_filter=F.get("name", F.lit(0)) != "e3",
        changes=log.union(more), write=False,
    )
    assert result.metrics["changes"] == n + 5
    assert result.metrics["series"] == 7 and result.metrics["non_finite"] == 2
    assert result.metrics["filtered_series"] == 6 and result.metrics["features"] == result.features.count() == 4
    with pytest.raises(Exception, match="non-finite features of series"):
        run(spark, spec(start=START, end=START + timedelta(days=5), transformation=("Normalize",)), changes=more, write=False)
    empty = run(spark, spec(start=START, end=START + timedelta(days=5), clustering_alg="KMeans"), changes=log.where("entity <> 'e0'"), write=False)
    assert empty.metrics["series"] == 5


def test_a_failing_first_attempt_does_not_count():
    """Two tasks of the last stage fail after they have passed rows on; each is tried again."""
    script = Path(__file__).parent / "failing_attempt.py"
    done = subprocess.run([sys.executable, str(script)], capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": str(script.parent.parent)})
    assert "failed attempts: 2" in done.stdout, done.stderr[-2000:]
    assert "{'changes': 4000, 'series': 200, 'filtered_series': 200, 'features': 200, 'non_finite': 0, 'members': 200}" in done.stdout


@pytest.fixture
def queries(spark, monkeypatch):
    """A plain table in place of what the database returns."""
    kinds = {
        "text": spark.createDataFrame([("a", "p", "v", "2024-01-01"), ("b", "p", "v", "2024-01-02 00:00:00"), ("b", "q", "v", None), ("c", "p", "v", "never")], "e string, p string, v string, t string"),
        "keyed": spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-02 00:00:00"), (None, "2024-01-02"), ("b", "never"), ("b", None)], "name string, t string"),
    }
    for module in (jdbc, job):
        monkeypatch.setattr(module, "read_query", lambda spark, database, query, partitioning=None: kinds[query])
    return kinds


DATABASE = Database("jdbc:none", "none")


def test_options_act_on_a_change_query(spark, queries):
    def read(**more):
        return sorted(tuple(r)[:2] for r in job.read_source(spark, spec(database=DATABASE, query="text", **more)).collect())

    assert read(missing_time="drop") == [("a", "p"), ("b", "p")]
    assert read(missing_time="drop", entities=("b",)) == [("b", "p")]
    assert read(entities=("a",)) == [("a", "p")]
    assert read(missing_time="drop", properties=("q",)) == []
    with pytest.raises(Exception, match="unreadable change time"):
        read()


def test_options_act_on_a_prefiltered_query(spark, queries):
    description = {"database": DATABASE, "query": "keyed", "query_prefiltered": True}
    source = job.read_source(spark, spec(missing_time="drop", **description))
    assert source.columns == ["key_1", "ts"] and sorted(r.key_1 for r in source.collect()) == ["a", "b", "null"]
    with pytest.raises(ValueError, match="pre-filtered"):
        spec(entities=("a",), **description)
    failing = job.read_source(spark, spec(**description))
    for plan in (failing, failing.select("key_1"), failing.groupBy().count()):  # whatever is used of it
        with pytest.raises(Exception, match="unreadable change time"):
            plan.collect()
    with pytest.raises(ValueError, match="on_error"):
        positional_keys(queries["keyed"], "ignore")


def test_lists_act_on_given_changes(spark):
    log, _ = changes(spark)
    result = run(spark, spec(start=START, end=START + timedelta(days=5), entities=("e1", "e2", "e5"), properties=("q",)), changes=log, write=False)
    assert result.metrics["series"] == 2


def test_a_job_can_be_resumed_under_its_identifier(spark):
    log, _ = changes(spark, 12)
    description = {"start": START, "end": START + timedelta(days=5), "resume": True, "config_identifier": "resumed-job"}
    first = run(spark, spec(max_iter=1, **description), changes=log, write=False)
    again = run(spark, spec(max_iter=9, **description), changes=log, write=False)
    straight = run(spark, spec(max_iter=9, **description | {"resume": False}), changes=log, write=False)
    centers = [[r.center for r in x.centers.orderBy("cluster").collect()] for x in (first, again, straight)]
    assert centers[1] == centers[2]
    with pytest.raises(ValueError, match="resume"):
        JobSpec(resume=True)


def test_scratch_folders_are_removed(spark):
    remove_scratch(spark)
    path = scratch_path(spark, "some")
    spark.range(3).write.parquet(path)
    local = Path(path.removeprefix("file:"))
    assert local.exists() and remove_scratch(spark) == 1 and not local.exists() and remove_scratch(spark) == 0
