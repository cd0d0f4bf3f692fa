import json
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from changeseries.__main__ import main
from changeseries.operators.kmeans import center_table
from changeseries.operators.matrix import CITIES
from changeseries.plans.job import read_source, run, write_run
from changeseries.plans.spec import JobSpec
from changeseries.sinks.jdbc import members_table
from changeseries.sinks.lines import centers_lines, centers_long, centers_long_lines, members_lines, write_lines
from changeseries.functions.text import preview
from changeseries.sources.jdbc import Database, Partitioning, query_options

CONFIG = {
    "start": "2020-01-01 00:00:00.0",
    "end": "2020-01-04 00:00:00",
    "fileSource": "in.csv",
    "resultDirectory": "out/",
    "addGroundTruth": False,
    "configIdentifier": "test",
    "granularity": 1,
    "unit": "Days",
    "transformation": ["Log", "none"],
    "featureExtraction": "Raw",
    "clusteringAlg": "KMeans",
    "KMeans Parameters": {"k": 2, "maxIter": 150, "seed": 13},
}
DATABASE = {"url": "jdbc:postgresql://host/db", "driver": "org.postgresql.Driver", "query": "SELECT a, ts FROM t"}


def test_spec_from_dict():
    spec = JobSpec.from_dict(CONFIG)
    assert (spec.start, spec.end) == (datetime(2020, 1, 1), datetime(2020, 1, 4))
    assert (spec.k, spec.max_iter, spec.seed) == (2, 150, 13)
    assert spec.transformation == ("Log", "none") and not spec.reads_database


def test_spec_bounds_count_only_together():
    spec = JobSpec.from_dict({key: value for key, value in CONFIG.items() if key != "end"})
    assert spec.start is None and spec.end is None


def test_spec_file_wins_over_database():
    with pytest.warns(UserWarning, match="the file is used"):
        spec = JobSpec.from_dict({**CONFIG, "dbSource": DATABASE})
    assert spec.file_source == "in.csv" and spec.database is None


def test_spec_database_queries_are_prefiltered():
    config = {key: value for key, value in CONFIG.items() if key not in ("fileSource", "resultDirectory")}
    spec = JobSpec.from_dict({**config, "dbSource": DATABASE})
    assert spec.reads_database and spec.query_prefiltered and spec.result_directory is None
    assert spec.database.user is None


@pytest.mark.parametrize(
    "change",
    [
        {"clusteringAlg": "kmeans"}, {"unit": "HalfDays"}, {"transformation": ["smooth"]},
        {"featureExtraction": "fourier"}, {"granularity": 0},
    ],
)
def test_spec_is_validated(change):
    with pytest.raises(ValueError):
        JobSpec.from_dict({**CONFIG, **change})


@pytest.mark.parametrize("missing", ["configIdentifier", "addGroundTruth", "granularity", "unit", "transformation", "resultDirectory"])
def test_spec_needs_its_fields(missing):
    with pytest.raises(KeyError):
        JobSpec.from_dict({key: value for key, value in CONFIG.items() if key != missing})


def test_spec_defaults():
    spec = JobSpec()
    assert (spec.granularity, spec.unit, spec.k, spec.max_iter) == (7, "Days", 10, 100)
    assert spec.feature_extraction == "raw" and spec.clustering_alg == "KMeans"


def test_no_source(spark):
    with pytest.raises(ValueError):
        read_source(spark, JobSpec())


def test_jdbc_options():
    database = Database("jdbc:x", "driver.Class", "me", "secret")
    assert "secret" not in repr(database)
    whole = query_options(database, "SELECT 1")
    assert whole["query"] == "SELECT 1" and whole["password"] == "secret" and whole["useSSL"] == "false"
    split = query_options(Database("jdbc:x", "d"), "SELECT 1", Partitioning("id", 0, 100, 8))
    assert split["dbtable"] == "(SELECT 1) queryresult" and split["numPartitions"] == "8"
    assert "query" not in split and "user" not in split


def test_lines(spark):
    members = spark.createDataFrame(
        [(['a"b', "c"], [1.0, float("nan")], 3, "city"), (["x"], [0.5], 0, None)],
        "name ARRAY<STRING>, features ARRAY<DOUBLE>, assignedCluster INT, trueCluster STRING",
    )
    assert sorted(row["value"] for row in members_lines(members).collect()) == [
        '"a""b||||c","3","city",1.0,NaN', '"x","0","",0.5'
    ]
    assert {row["value"] for row in members_lines(members.drop("trueCluster")).collect()} == {
        '"a""b||||c","3",1.0,NaN', '"x","0",0.5'
    }
    assert {tuple(row) for row in members_table(members).collect()} == {('a"b||||c', 3), ("x", 0)}
    assert members.select(preview("features").alias("p")).first()["p"] == "[1.0,NaN]"


def test_centers_are_padded(spark):
    centers = center_table(spark, [[1.0, 2.5, 1e-5], [3.0]])
    assert [row["value"] for row in centers_lines(centers).collect()] == ["1.0,2.5,1.0E-5", "3.0,NaN,NaN"]
    assert [row["value"] for row in centers_long_lines(centers).collect()][2:5] == ["2,1.0E-5,0", "0,3.0,1", "1,NaN,1"]
    assert centers_long(centers).count() == 6


def test_existing_output_is_not_overwritten(spark, tmp_path):
    lines = spark.createDataFrame([("a",)], "value STRING")
    write_lines(lines, str(tmp_path / "out"), single_file=True)
    with pytest.raises(Exception, match="exists"):
        write_lines(lines, str(tmp_path / "out"))


def written(folder):
    return sorted(line for part in Path(folder).glob("part-*") for line in part.read_text().splitlines())


@pytest.fixture
def source(tmp_path):
    lines = []
    for entity, busy_day in (("a", 1), ("b", 1), ("c", 3), ("d", 3)):
        for _ in range(60):
            lines.append(f"{entity},p,v,2020-01-0{busy_day} 10:00:00.000000")
    lines += ["quiet,p,v,2020-01-02", "broken,p"]
    path = tmp_path / "in.csv"
    path.write_text("\n".join(lines) + "\n")
    return path


@pytest.mark.parametrize("algorithm", ["KMeans", "DBAKMeans"])
def test_command_line_cluster(spark, tmp_path, source, algorithm):
    # One change of d comes earlier, so that warping cannot align all series.
    source.write_text(source.read_text() + "d,p,v,2020-01-01\n")
    labels = tmp_path / "labels.csv"
    labels.write_text("A,infobox film\nc,infobox film\nd,other\n")
    parameters = {"k": 2, "maxIter": 20, "seed": 3}
    config = {
        **CONFIG, "fileSource": str(source), "resultDirectory": f"{tmp_path}/", "addGroundTruth": True,
        "transformation": [], "clusteringAlg": algorithm, f"{algorithm} Parameters": parameters,
    }
    (tmp_path / "config.json").write_text(json.dumps(config))
    main(["cluster", str(tmp_path / "config.json"), "--labels", str(labels)])
    members = written(tmp_path / "test/members.csv")
    assert [line.split(",")[0] for line in members] == ['"a"', '"c"']
    assert [line.split(",")[2:] for line in members] == [
        ['"infobox film"', "60.0", "0.0", "0.0"], ['"infobox film"', "0.0", "0.0", "60.0"]
    ]
    assert len(written(tmp_path / "test/centers.csv")) == 2
    assert len(written(tmp_path / "test/clusterCentersTransposed.csv")) == 6


def test_command_line_explore_writes_nothing(spark, tmp_path, source, capsys):
    config = {**CONFIG, "fileSource": str(source), "resultDirectory": f"{tmp_path}/results/"}
    (tmp_path / "config.json").write_text(json.dumps(config))
    main(["explore", str(tmp_path / "config.json")])
    assert "assignedCluster" in capsys.readouterr().out
    assert not (tmp_path / "results").exists()


def test_command_line_matrix(spark, tmp_path):
    lines = [f"{city},name,v,2020-01-01\n{city},area,v,2020-01-01" for city in CITIES]
    (tmp_path / "in.csv").write_text("\n".join([*lines, "Rome,area,v,2020-01-02", "Rome,mayor,v,2020-01-02", "Oslo,name,v,2020-01-01"]))
    main(["matrix", str(tmp_path / "in.csv"), str(tmp_path / "out")])
    (part,) = (tmp_path / "out").glob("part-*")
    rows = part.read_text().splitlines()
    assert rows[0] == "Settlement,area,name" and len(rows) == 10
    assert rows[1] == "Berlin,1,1" and "Rome,2,1" in rows


def test_run_with_hooks(spark, source):
    spec = JobSpec.from_dict({**CONFIG, "fileSource": str(source), "transformation": []})
    result = run(
        spark, spec, keys=["entity", "property"], change_filter=lambda changes: changes.filter("entity <> 'a'"),
        group_filter=F.col("n") > 50, series_filter=F.array_max("y") > 1, write=False,
    )
    assert {tuple(row["name"]) for row in result.members.collect()} == {("b", "p"), ("c", "p"), ("d", "p")}
    assert result.windows.count == 3 and result.centers.count() == 2


def test_ground_truth_needs_labels(spark, source):
    with pytest.raises(ValueError, match="labels"):
        run(spark, JobSpec.from_dict({**CONFIG, "fileSource": str(source), "addGroundTruth": True}))


def test_writing_needs_a_directory(spark):
    with pytest.raises(ValueError, match="directory"):
        write_run(None, None, JobSpec())
