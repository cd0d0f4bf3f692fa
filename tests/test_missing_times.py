"""Changes without a readable time, filters that reach the scan, and checks before the first job."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from changeseries.__main__ import main
from changeseries.functions.windows import TimeWindows
from changeseries.operators import matrix, series
from changeseries.plans import catalog
from changeseries.plans.job import run
from changeseries.plans.spec import JobSpec
from changeseries.sources.changelog import change_log, read_change_csv

FOLDER = "/root/testdata/sf0.001"
WINDOWS = [TimeWindows(datetime(2024, 1, 1), datetime(2024, 1, 4), 1, "Days"), TimeWindows(datetime(2024, 1, 1), datetime(2024, 4, 1), 1, "Months")]


def changes(spark):
    rows = [("a", "p", "v", None), ("b", "p", "v", datetime(2024, 1, 2)), ("b", "p", "v", None), ("b", "q", "v", datetime(2023, 1, 1))]
    return spark.createDataFrame(rows, "entity string, property string, value string, ts timestamp_ntz")


@pytest.mark.parametrize("windows", WINDOWS)
@pytest.mark.parametrize("before", ["clamp", "drop"])
def test_missing_times_count_nowhere(spark, windows, before):
    with pytest.raises(Exception, match="no time"):
        series.build_series(changes(spark), ["entity"], windows, before_start=before).collect()
    got = series.build_series(changes(spark), ["entity"], windows, before_start=before, missing_time="drop").collect()
    first = 1.0 if before == "clamp" else 0.0
    want = [first, 1.0, 0.0] if windows.unit == "DAYS" else [first + 1.0, 0.0, 0.0]
    assert {r["name"][0]: r["y"] for r in got} == {"b": want}


def test_statistics_follow_the_same_rule(spark):
    for plan in (
        series.group_stats(changes(spark), ["entity"]).select("n"),
        series.time_bounds(changes(spark)),
        series.run_metrics(changes(spark), ["entity"]).select("groups", "changes"),
    ):
        with pytest.raises(Exception, match="no time"):
            plan.collect()
    (row,) = series.run_metrics(changes(spark), ["entity"], missing_time="drop").collect()
    assert (row["changes"], row["entities"], row["groups"]) == (2, 1, 1)
    with pytest.raises(ValueError):
        series.group_stats(changes(spark), ["entity"], missing_time="ignore")


def test_unreadable_times_fail_whatever_is_used(spark, tmp_path):
    (tmp_path / "log.csv").write_text("e,p,v,2024-01-01 00:00:00\nf,p,v,garbage\n")
    log = read_change_csv(spark, str(tmp_path / "log.csv"))
    for plan in (matrix.property_counts(log), series.distinct_entities(log), log.groupBy().count(), matrix.pair_counts(log)):
        with pytest.raises(Exception, match="unreadable change time: garbage"):
            plan.collect()
    assert read_change_csv(spark, str(tmp_path / "log.csv"), on_error="drop").count() == 1


@pytest.mark.parametrize("name", ["individual_filter", "dtw_pairs", "lifespan_rate_matrix", "complete_property_matrix_top10"])
def test_filters_reach_the_scan(spark, name, capsys):
    catalog.QUERIES[name](spark, FOLDER).explain()
    plan = capsys.readouterr().out
    assert "PushedFilters: []" not in plan and ("In(" in plan or "Or(" in plan or "EqualTo(" in plan)
    if name == "dtw_pairs":
        assert plan.count("FileScan") == 1 and "Join" not in plan


def test_raw_filter(spark):
    rows = spark.createDataFrame([("a", "p", "v", datetime(2024, 1, 1)), ("b", "p", "v", None)], "x string, y string, z string, t timestamp_ntz")
    assert change_log(rows, where=F.col("x") == "a").count() == 1


def config(tmp_path, **changes):
    values = {
        "configIdentifier": "r", "fileSource": str(tmp_path / "log.csv"), "resultDirectory": f"{tmp_path}/", "addGroundTruth": True, "granularity": 1, "unit": "Days",
        "transformation": [], "featureExtraction": "raw", "clusteringAlg": "KMeans", "KMeans Parameters": {"k": 2, "maxIter": 5, "seed": 1},
        "start": "2024-01-01 00:00:00.0", "end": "2024-01-04 00:00:00",
    } | changes
    (tmp_path / "job.json").write_text(json.dumps(values))
    return str(tmp_path / "job.json")


def log(tmp_path, constant=False):
    lines = [f"e{i},p,v,2024-01-0{d} 00:00:0{k}\n" for i in range(6) for d in (1, 2, 3) for k in range(1 + (not constant) * (i % 3) * d)]
    (tmp_path / "log.csv").write_text("".join(lines))
    (tmp_path / "labels.csv").write_text("".join(f"e{i},own template {i % 2}\n" for i in range(6)) + "e0,infobox film\n")


def test_own_templates_reach_the_members_through_the_command_line(spark, tmp_path, capsys):
    log(tmp_path)
    labels = str(tmp_path / "labels.csv")
    main(["cluster", config(tmp_path), "--labels", labels, "--templates", "own template 0", "--min-changes", "0", "-local"])
    assert "labels: 3, removed_labels: 4, members: 3" in capsys.readouterr().out
    lines = [r.value for r in spark.read.text(f"{tmp_path}/r/members.csv").collect()]
    assert len(lines) == 3 and all('"own template 0"' in line for line in lines)


def test_options_from_json_and_metrics(spark, tmp_path):
    log(tmp_path, constant=True)
    with (tmp_path / "log.csv").open("a") as more:
        more.write("x,p,v,2024-01-01 00:00:00\nx,p,v,2024-01-01 00:00:01\ny,p,v,2024-01-03 00:00:00\nz,p,v,garbage\n")
    path = config(tmp_path, addGroundTruth=False, transformation=["Normalize"], nonFinite="drop", missingTime="drop", labelTemplates=None)
    spec = JobSpec.from_json(path)
    assert spec.label_templates is None and spec.start == datetime(2024, 1, 1)
    result = run(spark, spec, write=False)
    assert result.metrics == {"changes": 21, "series": 8, "filtered_series": 8, "features": 2, "non_finite": 6, "members": 2}


@pytest.mark.parametrize(
    "wrong", [{"clustering_alg": "KMeans", "k": 1}, {"non_finite": "keep"}, {"max_iter": -1}, {"missing_time": "count"}, {"before_start": "x"}]
)
def test_wrong_descriptions_fail_before_any_job(wrong):
    with pytest.raises(ValueError):
        JobSpec(**wrong)


def test_a_missing_result_directory_fails_before_any_job(spark):
    spark.sparkContext.setJobGroup("early", "early checks")
    source = changes(spark)
    with pytest.raises(ValueError, match="result directory"):
        run(spark, JobSpec(), changes=source)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("early")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
