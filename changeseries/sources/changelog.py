"""Change logs: ``(entity, property, value, ts)`` from files or any DataFrame."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeseries.functions.numeric import once
from changeseries.functions.timestamps import wall_clock

CSV_SCHEMA = "entity STRING, property STRING, value STRING, ts STRING"


def text_or_null(column: Column) -> Column:
    """Key text; a missing value is the literal ``null``."""
    return F.coalesce(column.cast("string"), F.lit("null"))


def _kept(rows: DataFrame, column: str, values: Collection[str] | None) -> DataFrame:
    """Rows whose text form of ``column`` is one of ``values``.

    A text column is compared as it is, so that the filter reaches the scan; only
    a search for the word ``null`` must look behind the replacement of nulls.
    """
    if values is None:
        return rows
    is_text = isinstance(rows.schema[column].dataType, T.StringType)
    text = rows[column] if is_text and "null" not in values else text_or_null(rows[column])
    return rows.filter(text.isin(*values))


def change_log(
    rows: DataFrame,
    on_error: str = "raise",
    entities: Collection[str] | None = None,
    properties: Collection[str] | None = None,
    where: Column | None = None,
) -> DataFrame:
    """The first four columns of ``rows``, by position, as a change log.

    ``on_error`` says what happens to a missing or unreadable change time:
    ``"raise"`` fails the job, also if only other columns are used, ``"drop"``
    leaves the row out. ``entities`` and ``properties`` restrict the log where it
    is read, and so does ``where``, a condition on the raw rows.
    """
    if on_error not in ("raise", "drop"):
        raise ValueError("on_error must be 'raise' or 'drop'")
    if len(rows.columns) < 4:
        raise ValueError("a change log needs entity, property, value and time columns")
    if where is not None:
        rows = rows.filter(where)
    rows = _kept(_kept(rows, rows.columns[0], entities), rows.columns[1], properties)
    entity, prop, value, time = (rows[name] for name in rows.columns[:4])
    named = [text_or_null(entity).alias("entity"), text_or_null(prop).alias("property"), text_or_null(value).alias("value")]
    return _with_time(rows, named, time, rows.schema[3].dataType, on_error)


def _with_time(rows: DataFrame, named: list[Column], time: Column, kind: T.DataType, on_error: str) -> DataFrame:
    """The columns ``named`` and ``ts``; a time that cannot be read fails the job or leaves its row out."""
    if on_error not in ("raise", "drop"):
        raise ValueError("on_error must be 'raise' or 'drop'")
    ts = wall_clock(time, kind)
    # Text is parsed once, below the check; a time of another type costs nothing to look at twice.
    parsed = once(ts) if on_error == "raise" and isinstance(kind, T.StringType) else ts
    changes = rows.select(*named, parsed.alias("ts"), text_or_null(time).alias("_text"))
    readable = F.col("ts").isNotNull()
    if on_error == "raise":
        # A filter, unlike the column itself, is not pruned when nothing reads the time.
        message = F.concat(F.lit("unreadable change time: "), F.col("_text"), F.lit("; a change without a readable time fails the job"))
        readable = F.when(readable, True).otherwise(F.raise_error(message).cast("boolean"))
    return changes.filter(readable).drop("_text")


def read_change_csv(
    spark: SparkSession,
    path: str,
    escape: str = '"',
    multiline: bool = False,
    on_error: str = "raise",
    entities: Collection[str] | None = None,
    properties: Collection[str] | None = None,
    where: Column | None = None,
) -> DataFrame:
    """Header-less CSV file or directory; rows with a wrong column count are dropped.

    Column pruning is switched off for this reader: with it, rows are only
    tokenised as far as the query needs and malformed ones slip through.
    ``multiline`` allows line breaks inside quoted fields, but makes each file
    one unsplittable task, so leave it off for large files.
    """
    rows = (
        spark.read.schema(CSV_SCHEMA)
        .option("mode", "DROPMALFORMED")
        .option("columnPruning", "false")
        .option("escape", escape)
        .option("multiLine", multiline)
        .csv(path)
    )
    return change_log(rows, on_error, entities, properties, where)


def positional_keys(rows: DataFrame, on_error: str = "raise") -> DataFrame:
    """Rows of any query as a keyed log: last column is the time, the rest is the key.

    Returns ``(key_1, ..., key_m, ts)`` with text keys. ``on_error`` is that of ``change_log``.
    """
    *keys, time = rows.columns
    named = [text_or_null(rows[key]).alias(f"key_{i}") for i, key in enumerate(keys, 1)]
    return _with_time(rows, named, rows[time], rows.schema[-1].dataType, on_error)
