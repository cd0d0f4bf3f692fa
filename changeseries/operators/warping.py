"""Dynamic time warping in Arrow batches.

The point cost is the squared difference, paths are unconstrained and no root is
taken. The dynamic programme runs along anti-diagonals, vectorised over all
series and centers of a block, so Python steps number S + T and not S * T.

The nearest center is found without the full table of every pair. A path meets the first and the last
points of both series, and every other point at least somewhere in the other one's range: what
that costs bounds a pair from below. Centers are tried by rising bound, those beyond the best cost so
far never, and a pair is given up once both diagonals that its paths must cross cost more. What is left out costs
strictly more than the center that is found, so result and ties are those of the full tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements of one diagonal of a block: a few buffers of this size fit the CPU cache.
BLOCK_ELEMENTS = 1 << 17
# Series that a block should at least hold.
BLOCK_SERIES = 64
# Memory for the paths of a block.
BLOCK_BYTES = 1 << 25

# Diagonals after which pairs are given up that cost more than the best so far.
GIVE_UP_EVERY = 24
# What rounding may add to a bound; more than that is a real difference.
ROUNDING = 1e-9

# Where a cell comes from; the larger code is preferred on ties.
DIAGONAL, LEFT, UP = np.int8(0), np.int8(1), np.int8(2)


def _diagonal_bounds(t: int, rows: int, columns: int) -> tuple[int, int]:
    return max(0, t - columns + 1), min(rows - 1, t) + 1


def _stretch(
    centers: np.ndarray,
    series: np.ndarray,
    diagonals: range,
    last: np.ndarray,
    before: np.ndarray,
    pointers: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Costs of the last two diagonals after some more; ``last`` and ``before`` are overwritten.

    Position 0 of the buffers is the infinite border, position i + 1 belongs to
    center point i. With ``pointers`` (diagonals, S, ...) every cell also records
    its predecessor; ties prefer UP, then LEFT, then DIAGONAL.
    """
    rows, columns = len(centers), len(series)
    reverse = series[::-1]
    current, cost = np.full_like(last, np.inf), np.empty((rows, *last.shape[1:]))
    for t in diagonals:
        lo, hi = _diagonal_bounds(t, rows, columns)
        here = cost[lo:hi]
        shift = columns - 1 - t
        np.subtract(centers[lo:hi], reverse[shift + lo : shift + hi], out=here)
        np.multiply(here, here, out=here)
        target = current[lo + 1 : hi + 1]
        if t == 0:
            target[...] = here
        else:
            left, up, diagonal = last[lo + 1 : hi + 1], last[lo:hi], before[lo:hi]
            np.minimum(diagonal, left, out=target)
            if pointers is not None:
                # The codes are ordered, so the preferred one of two is the larger.
                leftward = (left <= diagonal).view(np.int8) * LEFT
                upward = (up <= target).view(np.int8) * UP
                np.maximum(leftward, upward, out=pointers[t - diagonals.start, lo:hi])
            np.minimum(target, up, out=target)
            np.add(target, here, out=target)
        before, last, current = last, current, before
    return last, before


def _borders(centers: np.ndarray, series: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    shape = np.broadcast_shapes(centers.shape[1:], series.shape[1:])
    return np.full((len(centers) + 1, *shape), np.inf), np.full((len(centers) + 1, *shape), np.inf)


def _walk(centers: np.ndarray, series: np.ndarray) -> np.ndarray:
    """Warping cost of broadcast stacks: centers (S, ...) against series (T, ...)."""
    diagonals = range(len(centers) + len(series) - 1)
    last, _ = _stretch(centers, series, diagonals, *_borders(centers, series))
    return last[len(centers)].copy()


def warping_costs(series: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Costs (n, k) of n series of equal length against k centers of equal length."""
    costs = np.empty((len(series), len(centers)))
    points = centers.shape[1]
    # The series of a block lie innermost, as the axis to vectorise over: take so few
    # centers at a time that it does not become short.
    some = max(1, min(len(centers), BLOCK_ELEMENTS // (points * BLOCK_SERIES)))
    block = max(1, BLOCK_ELEMENTS // (points * some))
    for at in range(0, len(series), block):
        rows = np.ascontiguousarray(series[at : at + block].T)[:, None, :]
        for first in range(0, len(centers), some):
            part = np.ascontiguousarray(centers[first : first + some].T)[:, :, None]
            costs[at : at + block, first : first + some] = _walk(part, rows).T
    return costs


def paired_costs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Costs (n,) of row i of ``first`` against row i of ``second``."""
    block = max(1, BLOCK_ELEMENTS // first.shape[1])
    parts = [
        _walk(
            np.ascontiguousarray(first[at : at + block].T),
            np.ascontiguousarray(second[at : at + block].T),
        )
        for at in range(0, len(first), block)
    ]
    return np.concatenate(parts) if parts else np.empty(0)


def barycenter_sums(series: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per series and center position: sum and number of the values warped to it.

    Row i of ``series`` is aligned with row i of ``centers``; both results have
    the shape of ``centers``.
    """
    sums, hits = np.zeros(centers.shape), np.zeros(centers.shape, dtype=np.int64)
    size = path_bytes(centers.shape[1], series.shape[1])
    block = max(1, BLOCK_BYTES // size)
    for at in range(0, len(series), block):
        part = slice(at, at + block)
        _trace(series[part], centers[part], sums[part], hits[part])
    return sums, hits


def stride(diagonals: int) -> int:
    """Diagonals between two kept ones: pointers of a stretch then weigh as much as all kept costs."""
    return max(1, 4 * math.isqrt(diagonals))


def path_bytes(rows: int, columns: int) -> int:
    """Memory for the path of one series: two kept diagonals of doubles per stretch, pointers of one stretch."""
    diagonals = rows + columns - 1
    step = stride(diagonals)
    return rows * (min(step, diagonals) + 16 * -(-diagonals // step))


def _trace(series: np.ndarray, centers: np.ndarray, sums: np.ndarray, hits: np.ndarray) -> None:
    """Follow the cheapest paths back to their beginnings.

    The first pass keeps the costs at the beginning of every stretch of diagonals. Walking
    back, a stretch is computed again with its pointers, so that memory grows with the length
    to the power of one and a half, not two, at twice the work.
    """
    n, rows, columns = len(series), centers.shape[1], series.shape[1]
    centers, across = np.ascontiguousarray(centers.T), np.ascontiguousarray(series.T)
    diagonals = rows + columns - 1
    step = stride(diagonals)
    stretches = [range(t, min(t + step, diagonals)) for t in range(0, diagonals, step)]
    last, before = _borders(centers, across)
    kept = []
    for stretch in stretches[:-1]:
        kept.append((last.copy(), before.copy()))
        last, before = _stretch(centers, across, stretch, last, before)
    kept.append((last, before))
    everyone = np.arange(n)
    i, j = np.full(n, rows - 1), np.full(n, columns - 1)
    pointers = np.empty((min(step, diagonals), rows, n), dtype=np.int8)
    for stretch in reversed(stretches):
        pointers[...] = 0
        _stretch(centers, across, stretch, *kept.pop(), pointers)
        at = everyone[i + j >= stretch.start]
        while len(at):
            # A series appears once per step, so plain indexed addition is safe.
            here_i, here_j = i[at], j[at]
            sums[at, here_i] += series[at, here_j]
            hits[at, here_i] += 1
            move = pointers[here_i + here_j - stretch.start, here_i, at]
            done = (here_i == 0) & (here_j == 0)
            i[at] = np.where(done, -1, here_i - (move != LEFT))
            j[at] = np.where(done, -1, here_j - (move != UP))
            at = at[i[at] + j[at] >= stretch.start]


def stacks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The lists of an Arrow column as matrices: (row numbers, values), one per length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if column.null_count or not lengths.all():
        raise ValueError("series must be non-empty arrays")
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    starts = np.cumsum(lengths) - lengths
    for size in np.unique(lengths):
        at = np.flatnonzero(lengths == size)
        yield at, values[starts[at][:, None] + np.arange(size)]


def distinct(series: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows, and for every row the number of its like among them.

    Sparse count series repeat a lot, and a repeated one need not be warped again.
    """
    whole = np.ascontiguousarray(series).view(np.dtype((np.void, series.shape[1] * series.itemsize)))
    _, first, like = np.unique(whole.ravel(), return_index=True, return_inverse=True)
    return series[first], like


def shared_centers(rows: DataFrame, centers: Sequence[Sequence[float]]) -> Broadcast:
    """Centers sent once to every executor, not with every task, eight bytes a value.

    Their size is set by the job, number of clusters times windows, not by the data.
    """
    return rows.sparkSession.sparkContext.broadcast([np.asarray(c, dtype=np.float64) for c in centers])


def center_groups(centers: Sequence[Sequence[float]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Centers as matrices, one per center length: (center numbers, values)."""
    sizes = np.array([len(center) for center in centers])
    return [
        (at, np.array([centers[i] for i in at], dtype=np.float64))
        for at in (np.flatnonzero(sizes == size) for size in np.unique(sizes))
    ]


def _beyond(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of values to a range."""
    gap = np.maximum(np.maximum(values - high, low - values), 0)
    return np.multiply(gap, gap, out=gap)


def lower_bounds(series: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """(n, k): no more than the warping costs of n series against k centers, but for rounding."""
    ends = (series[:, :1] - centers[:, 0]) ** 2
    if series.shape[1] > 1 or centers.shape[1] > 1:
        ends = ends + (series[:, -1:] - centers[:, -1]) ** 2
    inner, low, high = series[:, 1:-1], series.min(axis=1, keepdims=True), series.max(axis=1, keepdims=True)
    bounds = np.empty((len(series), len(centers)))
    for number, center in enumerate(centers):
        of_series = _beyond(inner, center.min(), center.max()).sum(axis=1)
        of_center = _beyond(center[None, 1:-1], low, high).sum(axis=1)
        bounds[:, number] = np.maximum(of_series, of_center)
    return ends + bounds


def _walk_below(centers: np.ndarray, series: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Warping costs of pairs, column by column; infinite where they are certain to be above ``limit``."""
    rows, columns = len(centers), len(series)
    diagonals, out, pairs = rows + columns - 1, np.full(len(limit), np.inf), np.arange(len(limit))
    last, before = _borders(centers, series)
    for start in range(0, diagonals, GIVE_UP_EVERY):
        end = min(start + GIVE_UP_EVERY, diagonals)
        last, before = _stretch(centers, series, range(start, end), last, before)
        if end == diagonals or end < 2:
            continue
        crossed = [diagonal[lo + 1 : hi + 1].min(axis=0) for diagonal, t in ((last, end - 1), (before, end - 2)) for lo, hi in [_diagonal_bounds(t, rows, columns)]]
        on = ~(np.minimum(*crossed) > limit)  # also where a value is not a number
        if np.count_nonzero(on) < 0.75 * len(on):
            pairs, limit = pairs[on], limit[on]
            if not len(pairs):
                return out
            centers, series, last, before = (np.ascontiguousarray(a[:, on]) for a in (centers, series, last, before))
    out[pairs] = last[rows]
    return out


def _pair_costs(series: np.ndarray, groups: list[tuple[np.ndarray, np.ndarray]], of_series: np.ndarray, of_center: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Costs of the given pairs up to their limits."""
    out = np.full(len(of_series), np.inf)
    for at, centers in groups:
        place = np.full(of_center.max(initial=0) + 1, -1)
        place[at[at < len(place)]] = np.flatnonzero(at < len(place))
        mine = np.flatnonzero(place[of_center] >= 0)
        block = max(1, BLOCK_ELEMENTS // centers.shape[1])
        for first in range(0, len(mine), block):
            some = mine[first : first + block]
            left = np.ascontiguousarray(centers[place[of_center[some]]].T)
            out[some] = _walk_below(left, np.ascontiguousarray(series[of_series[some]].T), limit[some])
    return out


def nearest(
    series: np.ndarray, groups: list[tuple[np.ndarray, np.ndarray]], tally: dict[str, int] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Number and cost of the cheapest center; the first one on ties, -1 if none is finite.

    ``tally`` counts the pairs and those whose tables were begun.
    """
    n, k = len(series), sum(len(at) for at, _ in groups)
    bounds, costs = np.empty((n, k)), np.full((n, k), np.inf)
    for at, centers in groups:
        bounds[:, at] = lower_bounds(series, centers) * (1 - ROUNDING)
    everyone = np.arange(n)
    order = bounds.argsort(axis=1, kind="stable")
    costs[everyone, order[:, 0]] = _pair_costs(series, groups, everyone, order[:, 0], np.full(n, np.inf))
    costs[np.isnan(costs)] = np.inf
    best = costs.min(axis=1)
    begun, some, tried = n, 1, 1
    while tried < k:
        next_ones = order[:, tried : tried + some]
        open_ = ~(np.take_along_axis(bounds, next_ones, axis=1) > best[:, None])
        rows, column = np.nonzero(open_)
        if len(rows):
            chosen = next_ones[rows, column]
            costs[rows, chosen] = np.nan_to_num(_pair_costs(series, groups, rows, chosen, best[rows]), nan=np.inf, posinf=np.inf)
            best = costs.min(axis=1)
            begun += len(rows)
        elif not np.isnan(bounds).any():
            break  # bounds rise along the order, so no later center can be nearer
        tried, some = tried + some, 2 * some
    if tally is not None:
        tally["pairs"] = tally.get("pairs", 0) + n * k
        tally["begun"] = tally.get("begun", 0) + begun
    best = costs.argmin(axis=1)
    cheapest = costs[everyone, best]
    return np.where(np.isfinite(cheapest), best, -1), cheapest


@F.arrow_udf(T.DoubleType())
def _distance(first: pa.Array, second: pa.Array) -> pa.Array:
    out = np.empty(len(first))
    for at, left in stacks(first):
        for within, right in stacks(second.take(pa.array(at))):
            out[at[within]] = paired_costs(left[within], right)
    return pa.array(out)


def dtw_distance(first: Column | str, second: Column | str) -> Column:
    """Squared warping cost of two array columns of the same row."""
    return _distance(first, second)


def assign_nearest(
    series: DataFrame,
    centers: Sequence[Sequence[float]],
    features: str = "features",
    output: str = "assignedCluster",
    cost: str | None = None,
) -> DataFrame:
    """Add the number (and, if named, the cost) of the nearest center to every row."""
    shared = shared_centers(series, centers)
    added = [T.StructField(output, T.IntegerType())]
    if cost is not None:
        added.append(T.StructField(cost, T.DoubleType()))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = center_groups(shared.value)
        for batch in batches:
            best = np.empty(batch.num_rows, dtype=np.int32)
            price = np.empty(batch.num_rows)
            for at, values in stacks(batch.column(features)):
                rows, like = distinct(values)
                number, lowest = nearest(rows, groups)
                best[at], price[at] = number[like], lowest[like]
            extra = [pa.array(best), pa.array(price)][: len(added)]
            names = [*batch.schema.names, *[field.name for field in added]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=names)

    return series.mapInArrow(assign, T.StructType([*series.schema.fields, *added]))
