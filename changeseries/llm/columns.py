"""Column expressions over text that several operators share.

A word is a run of characters other than space and ``\\t\\n\\v\\f\\r``; only the
letters A-Z have a lower case here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The words in their order; an empty list for null and for text without a word."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def character_count(text: Column, characters: str) -> Column:
    """How many of ``characters`` the text holds."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")
