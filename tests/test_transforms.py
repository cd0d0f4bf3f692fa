import math

import pytest
from pyspark.sql import functions as F

from changeseries.functions.features import extract_features, register_features
from changeseries.functions.transforms import apply_transforms, cutoff_at, register_transform
from changeseries.functions.windows import TimeWindows
from changeseries.operators.series import transform_series
from datetime import datetime

NAN, INF = float("nan"), float("inf")


def values(spark, y, transforms, windows=None):
    rows = spark.createDataFrame([(y,)], "y ARRAY<DOUBLE>")
    return rows.select(apply_transforms(F.col("y"), transforms, windows).alias("y")).first()["y"]


def same(left, right):
    assert len(left) == len(right)
    for a, b in zip(left, right):
        assert (math.isnan(a) and math.isnan(b)) or a == b or math.isclose(a, b, rel_tol=1e-12)


@pytest.mark.parametrize(
    ("name", "y", "expected"),
    [
        ("none", [1.0, 2.0], [1.0, 2.0]),
        (" Normalize ", [1.0, 3.0], [-1.0, 1.0]),
        ("normalize", [2.0, 2.0, 2.0], [NAN] * 3),
        ("NORMALIZE", [], []),
        ("Log", [0.0, math.e - 1, -1.0, -2.0], [0.0, 1.0, -INF, NAN]),
        ("sqrt", [4.0, -1.0, 0.0], [2.0, NAN, 0.0]),
        ("removeLeadingZero", [0.0, 0.0, 3.0, 1.0], [3.0, 1.0, 0.0, 0.0]),
        ("removeLeadingZero", [0.0, 0.0], [0.0, 0.0]),
        ("removeLeadingZero", [-1.0, 0.0, 2.0], [2.0, 0.0, 0.0]),
        ("removeLeadingZero", [NAN, 2.0], [2.0, 0.0]),
        ("removeLeadingZero", [5.0, 0.0], [5.0, 0.0]),
    ],
)
def test_transform(spark, name, y, expected):
    same(values(spark, y, [name]), expected)


def test_chain_goes_left_to_right(spark):
    windows = TimeWindows(datetime(2000, 1, 1), datetime(2010, 1, 1), 1, "Years")
    y = [0.0, 1.0, 3.0, 5.0, 7.0, 9.0, 0.0, 0.0, 0.0, 0.0]
    expected = [-2 / math.sqrt(8 / 3), 0.0, 2 / math.sqrt(8 / 3)]
    same(values(spark, y, ["RemoveLeadingZero", "cutoffAt", "Normalize"], windows), expected)
    same(values(spark, y, []), y)


def test_cutoff(spark):
    windows = TimeWindows(datetime(2000, 1, 1), datetime(2010, 1, 1), 1, "Years")
    assert values(spark, [1.0] * 10, ["cutoffat"], windows) == [1.0] * 3
    rows = spark.createDataFrame([([1.0] * 10,)], "y ARRAY<DOUBLE>")
    assert len(rows.select(cutoff_at(5)(F.col("y"), windows).alias("y")).first()["y"]) == 5
    with pytest.raises(ValueError):
        values(spark, [1.0], ["cutoffAt"])


def test_user_transforms(spark):
    register_transform("Double It", lambda y: F.transform(y, lambda x: x * 2))
    assert values(spark, [1.0, 2.0], ["double it", lambda y: F.slice(y, 1, 1)]) == [2.0]
    with pytest.raises(ValueError):
        values(spark, [1.0], ["smooth"])


def test_series_filter_sees_the_transformed_series(spark):
    rows = spark.createDataFrame([(["a"], [4.0]), (["b"], [9.0])], "name ARRAY<STRING>, y ARRAY<DOUBLE>")
    kept = transform_series(rows, ["sqrt"], series_filter=F.get("y", F.lit(0)) > 2)
    assert [row["name"] for row in kept.collect()] == [["b"]]


def test_features(spark):
    rows = spark.createDataFrame([([1.0, 0.0, 4.0],), ([NAN, 1.0],)], "y ARRAY<DOUBLE>")
    assert rows.select(extract_features(F.col("y"), "Raw").alias("f")).first()["f"] == [1.0, 0.0, 4.0]
    first, second = (row["f"] for row in rows.select(extract_features(F.col("y"), " Statistics").alias("f")).collect())
    assert first == [0.0, 4.0, 5.0, 3.0]
    same(second, [NAN, NAN, NAN, 2.0])
    register_features("Peak", lambda y: F.array(F.array_max(y)))
    assert rows.select(extract_features(F.col("y"), "peak").alias("f")).first()["f"] == [4.0]
    with pytest.raises(ValueError):
        extract_features(F.col("y"), "fourier")
