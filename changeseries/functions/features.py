"""Feature extraction: one array of doubles per series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from changeseries.functions.numeric import NAN, has_nan, length, let, total


def raw(y: Column) -> Column:
    return y


def statistics(y: Column) -> Column:
    """``[min, max, sum, length]``; one NaN makes min, max and sum NaN."""

    def describe(v: Column) -> Column:
        return F.when(
            F.size(v) > 0,
            F.array(
                F.when(has_nan(v), F.lit(NAN)).otherwise(F.array_min(v)),
                F.when(has_nan(v), F.lit(NAN)).otherwise(F.array_max(v)),
                total(v),
                length(v),
            ),
        ).otherwise(F.raise_error(F.lit("statistics of an empty series")).cast("array<double>"))

    return let(y, describe)


_EXTRACTORS: dict[str, Callable[[Column], Column]] = {"raw": raw, "statistics": statistics}


def register_features(name: str, function: Callable[[Column], Column]) -> None:
    _EXTRACTORS[name.strip().lower()] = function


def find_features(method: str | Callable[[Column], Column]) -> Callable[[Column], Column]:
    if callable(method):
        return method
    try:
        return _EXTRACTORS[method.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown feature extraction: {method!r}") from None


def extract_features(y: Column, method: str | Callable[[Column], Column] = "raw") -> Column:
    return find_features(method)(y)
