"""Column helpers for arrays of doubles.

All of them are higher-order-function expressions, so they stay inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``.

    Without it, a chain of transforms that mention their input more than once
    would copy the whole upstream expression for every mention.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(value: Column) -> Column:
    """``value`` as a column of its own that the optimizer does not copy.

    A filter on a computed column is pushed below the projection, which computes
    the column again for every mention. A generator over a single element yields
    the same rows and keeps the filter above it. Use it alone in a ``select``.
    """
    return F.explode(F.array(value))


def total(values: Column) -> Column:
    """Left-to-right sum of an array of doubles."""
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def length(values: Column) -> Column:
    return F.size(values).cast("double")


def ieee_divide(numerator: Column, denominator: Column) -> Column:
    """Floating-point division: x/0 is an infinity and 0/0 is NaN, never an error."""
    return (
        F.when(denominator != 0, numerator / denominator)
        .when(F.isnan(numerator) | (numerator == 0), F.lit(NAN))
        .when(numerator > 0, F.lit(INF))
        .otherwise(F.lit(-INF))
    )


def has_nan(values: Column) -> Column:
    return F.exists(values, F.isnan)


def is_finite(values: Column) -> Column:
    """True when no element is NaN or infinite."""
    return F.forall(values, lambda x: ~F.isnan(x) & (F.abs(x) != INF))
