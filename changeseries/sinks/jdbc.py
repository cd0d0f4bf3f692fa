"""Clustering results as database tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeseries.functions.text import joined_name
from changeseries.sinks.lines import centers_long
from changeseries.sources.jdbc import Database


def members_table(members: DataFrame) -> DataFrame:
    return members.select(joined_name(F.col("name")).alias("name"), "assignedCluster")


def write_clusters(
    members: DataFrame, centers: DataFrame, database: Database, identifier: str, mode: str = "error"
) -> None:
    """Tables ``<identifier>`` and ``<identifier>_centers``.

    Centers go out in long form, as many databases have no array type. Every
    partition opens a connection of its own; the option ``numPartitions`` of the
    Spark writer bounds them if the database asks for it.
    """
    tables = {identifier: members_table(members), f"{identifier}_centers": centers_long(centers)}
    for table, rows in tables.items():
        rows.write.format("jdbc").options(**database.options(), dbtable=table).mode(mode).save()
