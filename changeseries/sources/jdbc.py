"""JDBC queries as a source."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from changeseries.sources.changelog import change_log


@dataclass(frozen=True)
class Database:
    """Where the data lies. Credentials have no defaults."""

    url: str
    driver: str
    user: str | None = None
    password: str | None = field(default=None, repr=False)

    def options(self) -> dict[str, str]:
        known = {
            "url": self.url,
            "driver": self.driver,
            "user": self.user,
            "password": self.password,
            "useUnicode": "true",
            "useSSL": "false",
        }
        return {key: value for key, value in known.items() if value is not None}


@dataclass(frozen=True)
class Partitioning:
    """How Spark splits a JDBC read: ranges of a numeric, date or timestamp column."""

    column: str
    lower: str
    upper: str
    partitions: int


def query_options(
    database: Database, query: str, partitioning: Partitioning | None = None
) -> dict[str, str]:
    """Reader options for a query.

    An unpartitioned read is one task. With ``partitioning`` the query becomes a
    derived table that every task restricts to its own range.
    """
    # Times are wall clocks, so ask for timestamps without a zone.
    options = {**database.options(), "preferTimestampNTZ": "true"}
    if partitioning is None:
        return {**options, "query": query}
    return {
        **options,
        "dbtable": f"({query}) queryresult",
        "partitionColumn": partitioning.column,
        "lowerBound": str(partitioning.lower),
        "upperBound": str(partitioning.upper),
        "numPartitions": str(partitioning.partitions),
    }


def read_query(
    spark: SparkSession,
    database: Database,
    query: str,
    partitioning: Partitioning | None = None,
) -> DataFrame:
    return spark.read.format("jdbc").options(**query_options(database, query, partitioning)).load()


def read_change_query(
    spark: SparkSession,
    database: Database,
    query: str,
    partitioning: Partitioning | None = None,
    on_error: str = "raise",
    entities: Collection[str] | None = None,
    properties: Collection[str] | None = None,
) -> DataFrame:
    """A query whose first four columns are entity, property, value and time.

    The other options are those of ``change_log``; lists over text columns become part of the database's query.
    """
    return change_log(read_query(spark, database, query, partitioning), on_error, entities, properties)
