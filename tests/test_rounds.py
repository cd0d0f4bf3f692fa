"""Packed sums, rounds that can be resumed, and counting moves in one pass."""

import random

import numpy as np
import pytest

from changeseries.operators import dba

NAMED = "name ARRAY<STRING>, features ARRAY<DOUBLE>"


@pytest.fixture(scope="module")
def features(spark):
    draw = random.Random(3)
    rows = [([f"s{i:03}"], [float(draw.randint(0, 4)) for _ in range(9)]) for i in range(120)]
    return spark.createDataFrame(rows, NAMED).repartition(6).cache()


def values(clusters):
    return [row["center"] for row in clusters.centers.orderBy("cluster").collect()]


def test_sums_come_in_blocks_and_add_up(features, monkeypatch):
    start = dba.initial_centers(features, 3, 1)
    whole, prints, cost = dba.updated_centers(features, start)
    monkeypatch.setattr(dba, "BLOCK_POSITIONS", 4)
    partials = dba.barycenter_partials(features, start)
    assert partials.count() == 3 * (1 + 3)  # a summary and three blocks of nine positions
    again, same_prints, same_cost = dba.updated_centers(features, start)
    assert all((a == b).all() for a, b in zip(whole, again)) and same_prints == prints and same_cost == cost
    rows = dba.barycenter_positions(partials).collect()
    assert len(rows) == 27
    assert all(row.total / row.weight == whole[row.cluster][row.position] for row in rows)


def test_long_centers_are_few_rows(spark):
    rows = spark.createDataFrame([(["a"], [float(i % 7) for i in range(20_000)])], NAMED)
    start = [[0.0] * 50]
    assert dba.barycenter_partials(rows, start).count() == 2
    wide = dba.Rounds(spark, "unused", "job")
    assert wide.folder == "unused"
    table = dba.center_table(spark, [np.arange(300_000.0), [1.0]])
    assert [len(row.center) for row in table.orderBy("cluster").collect()] == [300_000, 1]


class Killed(Exception):
    pass


def test_a_broken_fit_goes_on(features, tmp_path, monkeypatch):
    straight = dba.fit_dba_kmeans(features, 4, 30, 7)
    expected = values(straight)
    real, calls = dba.updated_centers, []

    def counted(*args):
        if len(calls) == 2 and not calls[-1]:
            raise Killed
        calls.append(False)
        return real(*args)

    folder = str(tmp_path / "fit")
    monkeypatch.setattr(dba, "updated_centers", counted)
    with pytest.raises(Killed):
        dba.fit_dba_kmeans(features, 4, 30, 7, resume=folder)
    assert dba.Rounds(features.sparkSession, folder, dba.job_of(features, 4, 7, None)).last().round == 2
    (tmp_path / "fit" / "round=3" / "_temporary").mkdir(parents=True)  # what a killed writer leaves
    rounds = []
    monkeypatch.setattr(dba, "updated_centers", lambda *args: rounds.append(1) or real(*args))
    resumed = dba.fit_dba_kmeans(features, 4, 30, 7, resume=folder)
    assert values(resumed) == expected
    assert resumed.members.exceptAll(straight.members).count() == 0
    first = len(rounds)
    assert first >= 1
    assert values(dba.fit_dba_kmeans(features, 4, 30, 7, resume=folder)) == expected
    assert len(rounds) == first  # a finished fit is not computed again


def test_max_iter_counts_all_rounds(features, tmp_path):
    folder = str(tmp_path / "fit")
    dba.fit_dba_kmeans(features, 4, 1, 7, resume=folder)
    assert values(dba.fit_dba_kmeans(features, 4, 2, 7, resume=folder)) == values(dba.fit_dba_kmeans(features, 4, 2, 7))
    assert values(dba.fit_dba_kmeans(features, 4, 2, 7, resume=folder)) == values(dba.fit_dba_kmeans(features, 4, 2, 7))


def test_rounds_of_another_job_are_refused(features, tmp_path):
    folder = str(tmp_path / "fit")
    dba.fit_dba_kmeans(features, 3, 1, 7, resume=folder)
    for other in ({"k": 4}, {"seed": 8}, {"centers": [[0.0] * 9]}):
        with pytest.raises(ValueError, match="another job"):
            dba.fit_dba_kmeans(features, **{"k": 3, "max_iter": 1, "seed": 7, "resume": folder} | other)
    with pytest.raises(ValueError, match="another job"):
        dba.fit_dba_kmeans(features.limit(50), 3, 1, 7, resume=folder)


def test_moves_in_one_pass(features):
    start = dba.initial_centers(features, 3, 1)
    renewed, _, _ = dba.updated_centers(features, start)
    before = dba.fit_dba_kmeans(features, max_iter=0, centers=start).members
    after = dba.fit_dba_kmeans(features, max_iter=0, centers=renewed).members
    counted = dba.moved_between(features, start, renewed)
    assert counted.first()["moved"] == dba.assignment_changes(before, after).first()["moved"] > 0
    assert "hashpartitioning(name" not in counted._jdf.queryExecution().toString()
    assert dba.moved_between(features.where("false"), start, renewed).first()["moved"] == 0
