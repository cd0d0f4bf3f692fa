"""Series transforms: array of doubles in, array of doubles out.

A transform is a function ``(y, windows) -> Column``; names are matched trimmed
and without regard to case. Plain ``Column -> Column`` functions can be mixed in
anywhere a name is allowed, or registered under a name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from changeseries.functions.numeric import INF, NAN, ieee_divide, length, let, total
from changeseries.functions.windows import TimeWindows

Transform = Callable[[Column, "TimeWindows | None"], Column]

# Fixed value: how many years the named cut-off keeps.
CUTOFF_YEARS = 3


def normalize(y: Column) -> Column:
    """z-score with the population deviation; a constant series becomes NaN."""

    def scale(v: Column, mean: Column) -> Column:
        squares = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
        # The zero test stands outside of the loop, whose body runs once per value.
        return let(
            F.sqrt(ieee_divide(squares, length(v))),
            lambda sd: F.when(sd != 0, F.transform(v, lambda x: (x - mean) / sd)).otherwise(
                F.transform(v, lambda x: ieee_divide(x - mean, sd))
            ),
        )

    return let(y, lambda v: let(ieee_divide(total(v), length(v)), lambda mean: scale(v, mean)))


def log(y: Column) -> Column:
    """ln(y + 1); -1 gives -Infinity and anything below gives NaN."""
    return F.transform(
        y,
        lambda x: F.when(x > -1, F.ln(x + 1)).when(x == -1, F.lit(-INF)).otherwise(F.lit(NAN)),
    )


def sqrt(y: Column) -> Column:
    return F.transform(y, F.sqrt)


def remove_leading_zero(y: Column) -> Column:
    """Shift left to the first positive value and pad the tail with zeros."""

    def shift(v: Column) -> Column:
        positive = F.transform(v, lambda x: (x > 0) & ~F.isnan(x))
        return let(
            F.array_position(positive, F.lit(True)).cast("int"),
            lambda first: F.when(first <= 1, v).otherwise(
                F.concat(
                    F.slice(v, first, F.size(v) - first + 1),
                    F.array_repeat(F.lit(0.0), first - 1),
                )
            ),
        )

    return let(y, shift)


def cutoff(y: Column, keep: int) -> Column:
    return F.slice(y, 1, keep)


def cutoff_at(years: int = CUTOFF_YEARS, anchor: datetime | None = None) -> Transform:
    """Keep the windows of the first ``years`` years, counted from ``anchor``.

    ``anchor`` defaults to the start of the windows; it only moves leap-day rounding.
    """

    def apply(y: Column, windows: TimeWindows | None) -> Column:
        if windows is None:
            raise ValueError("cutoffAt needs the time windows of the series")
        return cutoff(y, windows.steps_in_years(years, anchor))

    return apply


def plain(function: Callable[[Column], Column]) -> Transform:
    return lambda y, windows: function(y)


_TRANSFORMS: dict[str, Transform] = {
    "none": plain(lambda y: y),
    "normalize": plain(normalize),
    "log": plain(log),
    "sqrt": plain(sqrt),
    "removeleadingzero": plain(remove_leading_zero),
    "cutoffat": cutoff_at(),
}


def register_transform(name: str, function: Callable[[Column], Column]) -> None:
    _TRANSFORMS[name.strip().lower()] = plain(function)


def find_transform(transform: str | Callable[[Column], Column]) -> Transform:
    if callable(transform):
        return plain(transform)
    try:
        return _TRANSFORMS[transform.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown time series transformation: {transform!r}") from None


def apply_transforms(
    y: Column,
    transforms: Iterable[str | Callable[[Column], Column]],
    windows: TimeWindows | None = None,
) -> Column:
    """Apply the transforms left to right; an empty list is the identity."""
    return reduce(lambda acc, step: find_transform(step)(acc, windows), transforms, y)
