"""Text layout of the line-oriented outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: separator between the parts of a series name.
NAME_SEPARATOR = "||||"


def joined_name(name: Column) -> Column:
    return F.array_join(name, NAME_SEPARATOR)


def quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit('"'))


def doubled_quotes(text: Column) -> Column:
    return F.replace(text, F.lit('"'), F.lit('""'))


def joined_values(values: Column) -> Column:
    return F.array_join(values.cast("array<string>"), ",")


def preview(values: Column) -> Column:
    """Short form for display: ``[1.0,2.5]``, one decimal each."""
    return F.concat(
        F.lit("["),
        F.array_join(F.transform(values, lambda x: F.format_string("%.1f", x)), ","),
        F.lit("]"),
    )
