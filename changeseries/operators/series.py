"""Changes to dense series: group, filter groups, count per time window.

Rows are aggregated twice. The first aggregation counts per (key, window), with a
partial count before its shuffle, so a key holding a third of all rows still
leaves each map task as at most one row per window. The second gathers a key's
non-empty windows, never more than the series is long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from changeseries.functions.numeric import once
from changeseries.functions.text import joined_name
from changeseries.functions.transforms import apply_transforms
from changeseries.functions.windows import TimeWindows
from changeseries.sources.changelog import text_or_null
from changeseries.storage import scratch_path

Key = str | Column
ChangeFilter = Column | Callable[[DataFrame], DataFrame]


def filter_changes(changes: DataFrame, keep: ChangeFilter | None) -> DataFrame:
    """Apply a predicate column or a DataFrame-to-DataFrame function."""
    if keep is None:
        return changes
    return keep(changes) if callable(keep) and not isinstance(keep, Column) else changes.filter(keep)


def filter_values(rows: DataFrame, column: str, values: Iterable[str]) -> DataFrame:
    """Keep rows whose ``column`` is one of ``values``."""
    return rows.filter(F.col(column).isin(*values))


def key_columns(keys: Sequence[Key]) -> list[Column]:
    """Key parts as text columns ``k0, k1, ...``; a missing part is ``null`` as text."""
    columns = [F.col(key) if isinstance(key, str) else key for key in keys]
    return [text_or_null(column).alias(f"k{i}") for i, column in enumerate(columns)]


def _key_names(keys: Sequence[Key]) -> list[str]:
    return [f"k{i}" for i in range(len(keys))]


def _name(keys: Sequence[Key]) -> Column:
    return F.array(*_key_names(keys)).cast("array<string>").alias("name")


def _timed(changes: DataFrame, ts: str, missing_time: str) -> DataFrame:
    """The changes with a time; with ``"error"`` a missing one fails the job."""
    if missing_time not in ("error", "drop"):
        raise ValueError("missing_time must be 'error' or 'drop'")
    return changes if missing_time == "error" else changes.filter(F.col(ts).isNotNull())


def _time(ts: str) -> Column:
    """The change time as a wall clock, whichever timestamp type it has; there must be one."""
    missing = F.raise_error(F.lit(f"a change has no time in {ts}")).cast("timestamp_ntz")
    return F.coalesce(F.col(ts).cast("timestamp_ntz"), missing)


def _stats(ts: str) -> list[Column]:
    """Statistics of a group. All look at the time, so that pruning cannot hide a missing one."""
    return [
        F.count(_time(ts)).alias("n"),
        F.min(_time(ts)).alias("min_ts"),
        F.max(_time(ts)).alias("max_ts"),
    ]


def group_stats(
    changes: DataFrame,
    keys: Sequence[Key],
    group_filter: Column | None = None,
    ts: str = "ts",
    missing_time: str = "error",
) -> DataFrame:
    """``(name, n, min_ts, max_ts)`` per group; ``group_filter`` is a predicate over them."""
    groups = _timed(changes, ts, missing_time).groupBy(*key_columns(keys)).agg(*_stats(ts))
    groups = groups.select(_name(keys), "n", "min_ts", "max_ts")
    return groups if group_filter is None else groups.filter(group_filter)


def time_bounds(
    changes: DataFrame,
    keys: Sequence[Key] = (),
    group_filter: Column | None = None,
    ts: str = "ts",
    missing_time: str = "error",
) -> DataFrame:
    """One row ``(min_ts, max_ts)`` over the changes of the groups that survive."""
    if group_filter is None:
        return _timed(changes, ts, missing_time).agg(*_stats(ts)).select("min_ts", "max_ts")
    return group_stats(changes, keys, group_filter, ts, missing_time).agg(
        F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts")
    )


def derive_windows(
    changes: DataFrame,
    keys: Sequence[Key],
    group_filter: Column | None = None,
    step: int = 7,
    unit: str = "Days",
    ts: str = "ts",
    missing_time: str = "error",
) -> TimeWindows:
    """Windows from the first to the last surviving change (one job, one row)."""
    first, last = time_bounds(changes, keys, group_filter, ts, missing_time).first()
    if first is None:
        raise ValueError("no change is left to derive the time bounds from")
    return TimeWindows.covering(first, last, step, unit)


def keyed_times(
    changes: DataFrame, keys: Sequence[Key], ts: str = "ts", missing_time: str = "error"
) -> DataFrame:
    """``(k0.., ts)``: what series need of a change."""
    return _timed(changes, ts, missing_time).select(*key_columns(keys), _time(ts).alias("ts"))


def stored_times(
    changes: DataFrame,
    keys: Sequence[Key],
    step: int = 7,
    unit: str = "Days",
    group_filter: Column | None = None,
    ts: str = "ts",
    missing_time: str = "error",
) -> tuple[DataFrame, TimeWindows]:
    """``(k0.., ts)`` of all changes, and windows from the first to the last one of the surviving groups.

    The source is read once: keys and times are written column by column, and their bounds are observed on the
    way; repeated tasks see the same times again, which moves no bound. Bounds of
    groups are looked up in the written columns.
    """
    spark, seen = changes.sparkSession, Observation()
    path = scratch_path(spark, "times")
    keyed_times(changes, keys, ts, missing_time).observe(seen, F.min("ts").alias("first"), F.max("ts").alias("last")).write.parquet(path)
    times = spark.read.parquet(path)
    first, last = seen.get["first"], seen.get["last"]
    if group_filter is not None and first is not None:
        first, last = time_bounds(times, _key_names(keys), group_filter).first()
    if first is None:
        raise ValueError("no change is left to derive the time bounds from")
    return times, TimeWindows.covering(first, last, step, unit)


def derived_series(
    changes: DataFrame,
    keys: Sequence[Key],
    group_filter: Column | None = None,
    step: int = 7,
    unit: str = "Days",
    ts: str = "ts",
    missing_time: str = "error",
) -> tuple[DataFrame, TimeWindows]:
    """Series over windows that the changes themselves span; the source is read once."""
    times, windows = stored_times(changes, keys, step, unit, group_filter, ts, missing_time)
    return build_series(times, _key_names(keys), windows, group_filter), windows


def window_counts(
    changes: DataFrame,
    keys: Sequence[Key],
    windows: TimeWindows,
    before_start: str = "clamp",
    ts: str = "ts",
    missing_time: str = "error",
) -> DataFrame:
    """Non-empty cells ``(k0.., slot, n, min_ts, max_ts)``, one per key and window."""
    if before_start not in ("clamp", "drop"):
        raise ValueError("before_start must be 'clamp' or 'drop'")
    slot = windows.slot(_time(ts), clamp_early=before_start == "clamp").alias("slot")
    return _timed(changes, ts, missing_time).groupBy(*key_columns(keys), slot).agg(*_stats(ts))


def _dense(cells: Column, count: int) -> Column:
    """Sorted ``(i, n)`` cells as an array of ``count`` doubles, gaps filled with zero.

    Each cell contributes the zeros since its predecessor and itself, so the work
    is linear in the length of the series. Appending is measurably cheaper here
    than concatenating.
    """

    def zeros_between(before: Column, at: Column) -> Column:
        return F.array_repeat(F.lit(0.0), at - before - 1)

    def position(index: Column) -> Column:
        return F.coalesce(F.get(cells, index)["i"], F.lit(-1))

    pieces = F.transform(
        cells,
        lambda cell, at: F.array_append(zeros_between(position(at - 1), cell["i"]), cell["n"]),
    )
    rest = zeros_between(position(F.size(cells) - 1), F.lit(count))
    return F.flatten(F.array_append(pieces, rest))


def build_series(
    changes: DataFrame,
    keys: Sequence[Key],
    windows: TimeWindows,
    group_filter: Column | None = None,
    before_start: str = "clamp",
    after_end: str = "error",
    ts: str = "ts",
    missing_time: str = "error",
) -> DataFrame:
    """``(name, y)``: one zero-filled array of change counts per surviving group.

    Changes before the start count in the first window (or are left out with
    ``before_start="drop"``). A surviving group with changes at or past the last
    edge fails the job (``after_end="error"``) or has them left out (``"drop"``).
    A change without a time fails the job (``missing_time="error"``) or counts nowhere (``"drop"``).
    ``group_filter`` is a predicate over ``n``, ``min_ts`` and ``max_ts`` of *all*
    changes of the group; it costs no further pass.
    """
    groups = series_groups(changes, keys, windows, None, before_start, after_end, ts, missing_time, having=group_filter)
    return groups.select("name", "y")


def series_groups(
    changes: DataFrame,
    keys: Sequence[Key],
    windows: TimeWindows,
    group_filter: Column | None = None,
    before_start: str = "clamp",
    after_end: str = "error",
    ts: str = "ts",
    missing_time: str = "error",
    having: Column | None = None,
) -> DataFrame:
    """``(name, n, kept, y)`` of all groups, also of those that ``group_filter`` does not keep: they have no ``y``.

    The rest is as in ``build_series``; ``having`` leaves groups out.
    """
    if after_end not in ("error", "drop"):
        raise ValueError("after_end must be 'error' or 'drop'")
    index = windows.index(F.col("slot"))
    cells = window_counts(changes, keys, windows, before_start, ts, missing_time).withColumn("i", index)
    inside = (F.col("i") >= 0) & (F.col("i") < windows.count)
    cell = F.struct(F.col("i").alias("i"), F.col("n").cast("double").alias("n"))
    groups = cells.groupBy(*_key_names(keys)).agg(
        F.sort_array(F.collect_list(F.when(inside, cell))).alias("cells"),
        F.max("i").alias("last_i"),
        F.sum("n").alias("n"),
        F.min("min_ts").alias("min_ts"),
        F.max("max_ts").alias("max_ts"),
    )
    if having is not None:
        groups = groups.filter(having)
    y = _dense(F.col("cells"), windows.count)
    if after_end == "error":
        message = F.concat(
            F.lit(f"changes at or past the last window edge {windows.last_edge}: "),
            joined_name(_name(keys)),
        )
        y = F.when(
            F.col("last_i") >= windows.count, F.raise_error(message).cast("array<double>")
        ).otherwise(y)
    if group_filter is None:
        return groups.select(_name(keys), "n", F.lit(True).alias("kept"), y.alias("y"))
    kept = F.coalesce(group_filter, F.lit(False))
    return groups.select(_name(keys), "n", kept.alias("kept"), F.when(kept, y).alias("y"))


def transform_series(
    series: DataFrame,
    transforms: Iterable[str | Callable[[Column], Column]],
    windows: TimeWindows | None = None,
    series_filter: Column | None = None,
) -> DataFrame:
    """Apply a chain of transforms to ``y``, then keep what ``series_filter`` accepts."""
    y = apply_transforms(F.col("y"), list(transforms), windows)
    others = [name for name in series.columns if name != "y"]
    if series_filter is None:
        return series.select(*others, y.alias("y"))
    return series.select(*others, once(y).alias("y")).filter(series_filter)


def run_metrics(
    changes: DataFrame,
    keys: Sequence[Key],
    group_filter: Column | None = None,
    ts: str = "ts",
    missing_time: str = "error",
) -> DataFrame:
    """Row counts of a run as one row, from one scan.

    Changes are counted by key and entity together first; grouping sets then add
    up these counts by key and by entity, so that no raw row is doubled.
    """
    names = _key_names(keys)
    rows = _timed(changes, ts, missing_time).select(
        *key_columns(keys), text_or_null(F.col("entity")).alias("entity"), _time(ts).alias("ts")
    )
    together = rows.groupBy(*names, "entity").agg(*_stats("ts"))
    groups = together.groupingSets([names, ["entity"]], *names, "entity").agg(
        F.grouping("entity").alias("by_key"),
        F.sum("n").alias("n"),
        F.min("min_ts").alias("min_ts"),
        F.max("max_ts").alias("max_ts"),
    )
    by_key = F.col("by_key") == 1
    kept = by_key if group_filter is None else by_key & group_filter
    return groups.agg(
        F.coalesce(F.sum(F.when(by_key, F.col("n"))), F.lit(0)).alias("changes"),
        F.count_if(~by_key).alias("entities"),
        F.count_if(by_key).alias("groups"),
        F.count_if(kept).alias("kept_groups"),
        F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)).alias("kept_changes"),
        F.min(F.when(kept, F.col("min_ts"))).alias("min_ts"),
        F.max(F.when(kept, F.col("max_ts"))).alias("max_ts"),
    )


def distinct_entities(changes: DataFrame) -> DataFrame:
    return changes.agg(F.count_distinct("entity").alias("entities"))

