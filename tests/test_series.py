import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from changeseries.functions.windows import FIXED_UNITS, TimeWindows, plus_months
from changeseries.operators import series

START = datetime(2020, 1, 1)


def log_of(spark, rows):
    return spark.createDataFrame(
        [(entity, "p", "v", ts) for entity, ts in rows],
        "entity STRING, property STRING, value STRING, ts TIMESTAMP_NTZ",
    )


def as_dict(rows):
    return {tuple(row["name"]): row["y"] for row in rows.collect()}


def counted_by_stepping(times, start, end, step, unit):
    """Windows walked one by one, each taking what lies before its end."""
    left, counts, edge = sorted(times), [], start
    while edge < end:
        edge = edge + step * FIXED_UNITS[unit] if unit in FIXED_UNITS else plus_months(edge, step)
        taken = [t for t in left if t < edge]
        left = left[len(taken):]
        counts.append(float(len(taken)))
    return counts, left


@pytest.mark.parametrize(
    ("step", "unit", "start", "days"),
    [
        (1, "DAYS", datetime(2020, 1, 1, 0, 0, 1), 9.5),
        (7, "DAYS", datetime(2001, 1, 18, 0, 0, 1), 100),
        (10, "MINUTES", datetime(2014, 2, 21), 0.5),
        (5, "HOURS", datetime(1969, 12, 30, 7), 6),
        (2, "WEEKS", datetime(2019, 12, 31, 13), 70),
        (45, "SECONDS", datetime(2020, 2, 29, 23, 59), 0.01),
        (1, "MONTHS", datetime(2020, 1, 31), 500),
        (1, "MONTHS", datetime(2019, 10, 31, 12, 30), 400),
        (5, "MONTHS", datetime(2020, 2, 29, 6), 900),
    ],
)
def test_series_equals_stepping_through_the_windows(spark, step, unit, start, days):
    end = start + timedelta(days=days)
    windows = TimeWindows(start, end, step, unit)
    draw = random.Random(step)
    span = windows.last_edge - start
    times = [start - span / 5 + 1.2 * span * draw.random() for _ in range(300)]
    times = [t for t in times if t < windows.last_edge] + [start, windows.last_edge - timedelta(microseconds=1)]
    if not windows.is_fixed:
        times += [edge for edge in windows.calendar_edges[:-1]]
        times += [edge - timedelta(microseconds=1) for edge in windows.calendar_edges]
    expected, left = counted_by_stepping(times, start, end, step, unit)
    assert not left and windows.count == len(expected)
    built = series.build_series(log_of(spark, [("e", t) for t in times]), ["entity"], windows)
    assert as_dict(built) == {("e",): expected}


@settings(max_examples=200, deadline=None)
@given(
    st.datetimes(datetime(1970, 1, 1), datetime(2100, 1, 1)),
    st.integers(1, 4000),
    st.integers(1, 40),
    st.sampled_from(["DAYS", "WEEKS", "HOURS", "MONTHS", "YEARS"]),
)
def test_window_count_and_edges(start, days, step, unit):
    end = start + timedelta(days=days)
    windows = TimeWindows(start, end, step, unit)
    months = step * 12 if unit == "YEARS" else step
    edge, count = start, 0
    while edge < end:
        edge = edge + step * FIXED_UNITS[unit] if windows.is_fixed else plus_months(edge, months)
        count += 1
    assert (windows.count, windows.last_edge) == (count, edge)


def test_month_edges_keep_the_clamped_day():
    windows = TimeWindows(datetime(2020, 1, 31), datetime(2020, 5, 1), 1, "Months")
    assert windows.calendar_edges == [
        datetime(2020, 1, 31), datetime(2020, 2, 29), datetime(2020, 3, 29),
        datetime(2020, 4, 29), datetime(2020, 5, 29),
    ]


def test_windows_are_validated():
    with pytest.raises(ValueError):
        TimeWindows(START, START, 1, "Days")
    with pytest.raises(ValueError):
        TimeWindows(START, datetime(2021, 1, 1), 0, "Days")
    with pytest.raises(ValueError):
        TimeWindows(START, datetime(2021, 1, 1), 1, "HalfDays")
    with pytest.raises(ValueError):
        TimeWindows(START, datetime(2021, 1, 1), 1, "Fortnights")


def test_cutoff_steps():
    windows = TimeWindows(datetime(2001, 1, 18, 0, 0, 1), datetime(2017, 8, 2, 0, 0, 1), 60, "Days")
    assert windows.count == 101
    assert windows.steps_in_years(3) == 18
    assert windows.steps_in_years(3, anchor=windows.end) == 18
    leap = TimeWindows(datetime(2016, 2, 29), datetime(2020, 1, 1), 1, "Months")
    assert leap.steps_in_years(3) == 35


def test_before_start_clamps_or_drops(spark):
    windows = TimeWindows(START, datetime(2020, 1, 4), 1, "Days")
    log = log_of(spark, [("e", datetime(2019, 1, 1)), ("e", datetime(2020, 1, 2)), ("old", datetime(2018, 1, 1))])
    assert as_dict(series.build_series(log, ["entity"], windows)) == {
        ("e",): [1.0, 1.0, 0.0], ("old",): [1.0, 0.0, 0.0]
    }
    assert as_dict(series.build_series(log, ["entity"], windows, before_start="drop")) == {
        ("e",): [0.0, 1.0, 0.0], ("old",): [0.0, 0.0, 0.0]
    }


@pytest.mark.parametrize(("unit", "end"), [("Days", datetime(2020, 1, 3)), ("Months", datetime(2020, 3, 1))])
def test_after_end_raises_or_drops(spark, unit, end):
    windows = TimeWindows(START, end, 1, unit)
    log = log_of(spark, [("e", START), ("e", end), ("f", START), ("f", START)])
    with pytest.raises(Exception, match="past the last window edge"):
        series.build_series(log, ["entity"], windows).collect()
    dropped = as_dict(series.build_series(log, ["entity"], windows, after_end="drop"))
    assert dropped == {("e",): [1.0, 0.0], ("f",): [2.0, 0.0]}


def test_late_changes_of_a_filtered_group_do_not_matter(spark):
    windows = TimeWindows(START, datetime(2020, 1, 3), 1, "Days")
    log = log_of(spark, [("late", datetime(2021, 1, 1)), ("e", START), ("e", START)])
    assert as_dict(series.build_series(log, ["entity"], windows, F.col("n") > 1)) == {("e",): [2.0, 0.0]}


def test_partial_last_window_counts(spark):
    windows = TimeWindows(START, datetime(2020, 1, 2), 18, "Hours")
    log = log_of(spark, [("e", datetime(2020, 1, 2, 11))])
    assert as_dict(series.build_series(log, ["entity"], windows)) == {("e",): [0.0, 1.0]}


def test_group_filter_is_strict(spark):
    log = log_of(spark, [("a", START)] * 50 + [("b", START)] * 51)
    groups = series.group_stats(log, ["entity"], F.col("n") > 50).collect()
    assert [row["name"] for row in groups] == [["b"]]


def test_derived_windows_include_the_last_change(spark):
    log = log_of(spark, [("a", START), ("b", START + timedelta(minutes=20)), ("c", START + timedelta(days=9))] )
    two = F.col("max_ts") < F.lit(datetime(2020, 1, 2)).cast("timestamp_ntz")
    windows = series.derive_windows(log, ["entity"], two, 10, "Minutes")
    assert windows.count == 3
    assert as_dict(series.build_series(log, ["entity"], windows, two)) == {
        ("a",): [1.0, 0.0, 0.0], ("b",): [0.0, 0.0, 1.0]
    }
    single = series.derive_windows(log_of(spark, [("a", START)]), ["entity"])
    assert single.count == 1
    with pytest.raises(ValueError):
        series.derive_windows(log.filter("false"), ["entity"])


def test_keys_of_several_parts_and_expressions(spark):
    log = log_of(spark, [("a", START), ("A", START)])
    windows = TimeWindows(START, datetime(2020, 1, 2), 1, "Days")
    built = as_dict(series.build_series(log, [F.lower("entity"), "property"], windows))
    assert built == {("a", "p"): [2.0]}
    assert as_dict(series.build_series(log, [], windows)) == {(): [2.0]}


def test_result_does_not_depend_on_partitions_or_session_zone(spark):
    # The clocks of this zone were put forward within the day.
    draw = random.Random(3)
    log = log_of(
        spark,
        [(draw.choice("abc"), datetime(2021, 3, 14) + timedelta(seconds=draw.random() * 86400)) for _ in range(500)],
    )
    windows = TimeWindows(datetime(2021, 3, 14), datetime(2021, 3, 15), 1, "Hours")
    expected = as_dict(series.build_series(log, ["entity"], windows))
    assert sum(map(sum, expected.values())) == 500
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert as_dict(series.build_series(log.repartition(8), ["entity"], windows)) == expected
        assert as_dict(series.build_series(log.coalesce(1), ["entity"], windows)) == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_zoned_times_are_taken_as_wall_clocks(spark):
    log = log_of(spark, [("a", datetime(2021, 3, 14, hour)) for hour in (1, 4, 23)])
    zoned = log.withColumn("ts", F.col("ts").cast("timestamp"))
    windows = TimeWindows(datetime(2021, 3, 14), datetime(2021, 3, 15), 4, "Hours")
    assert as_dict(series.build_series(zoned, ["entity"], windows)) == {("a",): [1.0, 1.0, 0.0, 0.0, 0.0, 1.0]}
    assert series.derive_windows(zoned, ["entity"], step=1, unit="Hours").count == 23


def test_metrics(spark):
    log = log_of(spark, [("a", START), ("a", START), ("b", datetime(2020, 1, 5))])
    row = series.run_metrics(log, ["entity", "value"], F.col("n") > 1).first()
    assert row.asDict() == {
        "changes": 3, "entities": 2, "groups": 2, "kept_groups": 1, "kept_changes": 2,
        "min_ts": START, "max_ts": START,
    }
    empty = series.run_metrics(log.filter("false"), ["entity"]).first()
    assert (empty["changes"], empty["groups"]) == (0, 0)


def test_individual_filter_forms(spark):
    log = log_of(spark, [("a", START), ("b", START)])
    assert series.filter_changes(log, None).count() == 2
    assert series.filter_changes(log, F.col("entity") == "a").count() == 1
    assert series.filter_changes(log, lambda changes: changes.limit(0)).count() == 0
    assert series.filter_values(log, "entity", ["b", "c"]).count() == 1


def test_plan_counts_before_it_shuffles_and_reads_two_columns(spark):
    from changeseries.plans.catalog import activity

    windows = TimeWindows(datetime(2024, 1, 1), datetime(2024, 1, 31), 1, "Days")
    built = series.build_series(activity(spark, "/root/testdata/sf0.001"), ["entity"], windows, F.col("n") > 50)
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in plan
    assert "Cartesian" not in plan and "Window" not in plan and "Python" not in plan
