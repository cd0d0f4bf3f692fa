"""Entity-by-property matrices of change counts and rates.

Everything is computed as long-form cells ``(entity, property, value)``; the wide
form is one pivot at the end. Rows shuffle only after they are counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeseries.functions.numeric import ieee_divide
from changeseries.functions.timestamps import whole_seconds_between
from changeseries.storage import stored

# The entities of the count matrix.
CITIES = (
    "Berlin",
    "Chicago",
    "Rome",
    "Stockholm",
    "Tokyo",
    "Cape Town",
    "Istanbul",
    "London",
    "Potsdam",
)

# The properties of the rate matrices.
RATE_PROPERTIES = (
    "leader_title",
    "leader_name",
    "population_note",
    "Name",
    "latm",
    "longd",
    "Region",
    "Website",
)

# Heading of the entity column, and how many properties are shown.
ROW_LABEL = "Settlement"
TOP_PROPERTIES = 10


def _among(changes: DataFrame, column: str, values: Sequence[str] | None) -> DataFrame:
    return changes if values is None else changes.filter(F.col(column).isin(*values))


def pair_counts(changes: DataFrame, properties: Sequence[str] | None = None) -> DataFrame:
    """``(entity, property, n, min_ts, max_ts)``; unused aggregates are pruned."""
    return _among(changes, "property", properties).groupBy("entity", "property").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts")
    )


def property_counts(changes: DataFrame, properties: Sequence[str] | None = None) -> DataFrame:
    return _among(changes, "property", properties).groupBy("property").agg(F.count(F.lit(1)).alias("n"))


def entity_counts(changes: DataFrame, properties: Sequence[str] | None = None) -> DataFrame:
    return _among(changes, "property", properties).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


def total_count(changes: DataFrame, properties: Sequence[str] | None = None) -> DataFrame:
    return _among(changes, "property", properties).agg(F.count(F.lit(1)).alias("n"))


def lifespan_seconds(pairs: DataFrame) -> Column:
    return whole_seconds_between(pairs["min_ts"], pairs["max_ts"])


def lifespans(changes: DataFrame, properties: Sequence[str] | None = None) -> DataFrame:
    """``(entity, property, lifespan)``: whole seconds from first to last change."""
    pairs = pair_counts(changes, properties)
    return pairs.select("entity", "property", lifespan_seconds(pairs).alias("lifespan"))


def complete_properties(changes: DataFrame, entities: Sequence[str]) -> DataFrame:
    """``(property, total, cells)`` of properties that every listed entity has changed.

    ``cells`` holds one count per listed entity, so it is as long as the list.
    """
    wanted = sorted(set(entities))
    counts = pair_counts(_among(changes, "entity", wanted))
    return (
        counts.groupBy("property")
        .agg(
            F.count(F.lit(1)).alias("entities"),
            F.sum("n").alias("total"),
            F.collect_list(F.struct("entity", "n")).alias("cells"),
        )
        .filter(F.col("entities") == len(wanted))
        .select("property", "total", "cells")
    )


def complete_case_cells(
    changes: DataFrame, entities: Sequence[str] = CITIES, top: int = TOP_PROPERTIES
) -> DataFrame:
    """Counts of the ``top`` most changed complete properties; ties go by name."""
    return (
        complete_properties(changes, entities)
        .orderBy(F.desc("total"), "property")
        .limit(top)
        .select("property", F.inline("cells").alias("entity", "n"))
        .select("entity", "property", "n")
    )


def property_share_cells(changes: DataFrame, properties: Sequence[str] | None = None) -> DataFrame:
    """``share``: an entity's part of all changes of the property.

    The totals come from the counts, not from the log; the join is left to the size
    statistics and the skew handling of Spark.
    """
    counts = pair_counts(changes, properties).select("entity", "property", "n")
    totals = counts.groupBy("property").agg(F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    return counts.join(totals, "property").select("entity", "property", share.alias("share"))


def lifespan_rate_cells(changes: DataFrame, properties: Sequence[str] | None = None) -> DataFrame:
    """``rate``: changes per second of lifespan; infinite where the lifespan is zero."""
    pairs = pair_counts(changes, properties)
    rate = ieee_divide(pairs["n"].cast("double"), lifespan_seconds(pairs).cast("double"))
    return pairs.select("entity", "property", rate.alias("rate"))


def pivot_matrix(
    cells: DataFrame,
    value: str,
    columns: Sequence[str] | None = None,
    row_label: str = ROW_LABEL,
    fill: float | None = None,
) -> DataFrame:
    """Cells as a matrix, entities down and properties across, both by name.

    Without ``columns`` Spark looks the property names up first, in a job of its own, and takes 10,000 at most;
    ``sinks.lines.write_matrix`` writes wider matrices from their cells.
    """
    pivot = cells.groupBy(F.col("entity").alias(row_label)).pivot(
        "property", None if columns is None else sorted(columns)
    )
    matrix = pivot.agg(F.first(value))
    matrix = matrix if fill is None else matrix.na.fill(fill)
    return matrix.orderBy(row_label)


def complete_case_matrix(
    changes: DataFrame, entities: Sequence[str] = CITIES, top: int = TOP_PROPERTIES
) -> DataFrame:
    """Wide form of ``complete_case_cells``.

    The column names must be known before the pivot, so the cells, at most ``top``
    for each listed entity, are stored first: the log is read once.
    """
    cells = stored(complete_case_cells(changes, entities, top))
    names = [row["property"] for row in cells.select("property").distinct().collect()]
    return pivot_matrix(cells, "n", names)
