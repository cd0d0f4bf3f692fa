"""Wall-clock timestamps: literals and the parser for change-log text.

Every timestamp of the library is a ``TIMESTAMP_NTZ``: a change log records wall
clocks, so an offset in the text is cut off, not applied, and no expression here
depends on the session time zone (only the cast of a zoned column does, and
there the session zone is what makes a wall clock of it).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The time given to a date without one, the accepted layout, and what an
# offset can begin with.
DATE_ONLY_SUFFIX = " 00:00:01.000000"
TIMESTAMP_LAYOUT = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d{0,6})?$"
OFFSET_SIGNS = ("+", "Z", "-")


def ntz(moment: datetime) -> Column:
    """Literal wall-clock timestamp."""
    return F.expr(f"TIMESTAMP_NTZ'{moment.isoformat(sep=' ', timespec='microseconds')}'")


def parse_timestamp_text(text: Column) -> Column:
    """Timestamp text to ``TIMESTAMP_NTZ``; null where the text has no valid form.

    * ``2014-02-21T10:00:00+01:00`` (also ``Z`` and ``-01:00``): offset dropped.
    * ``2014-02-21``: one second past midnight.
    * ``2014-02-21 10:00:00[.ffffff]``, also with line breaks inside the field.
    """
    time_of_day = F.split_part(text, F.lit("T"), F.lit(2))
    for sign in OFFSET_SIGNS:
        time_of_day = F.substring_index(time_of_day, sign, 1)
    iso = F.concat(F.substring_index(text, "T", 1), F.lit(" "), time_of_day)
    plain = F.when(F.contains(text, F.lit(" ")), text).otherwise(F.concat(text, F.lit(DATE_ONLY_SUFFIX)))
    cleaned = F.replace(
        F.when(F.contains(text, F.lit("T")), iso).otherwise(plain), F.lit("\n"), F.lit("")
    )
    # Extracting instead of testing mentions the text once, so it is put together once;
    # what has another layout becomes an empty text, which is no timestamp.
    return F.regexp_extract(cleaned, TIMESTAMP_LAYOUT, 0).try_cast("timestamp_ntz")


def wall_clock(column: Column, data_type: T.DataType) -> Column:
    """A timestamp or text column as ``TIMESTAMP_NTZ``; other types are refused."""
    if isinstance(data_type, T.TimestampNTZType):
        return column
    if isinstance(data_type, T.TimestampType):
        return column.cast("timestamp_ntz")
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType)):
        return parse_timestamp_text(column)
    raise TypeError(f"a change time must be a timestamp or text, not {data_type.simpleString()}")


def whole_seconds_between(first: Column, last: Column) -> Column:
    """``floor(last) - floor(first)`` in seconds, sub-second parts dropped first."""
    origin = ntz(datetime(1, 1, 1))
    second = F.expr("INTERVAL '1' SECOND")
    return F.call_function("div", last - origin, second) - F.call_function("div", first - origin, second)
