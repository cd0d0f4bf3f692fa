"""Quality rules: a threshold table compiled into one projection.

``measures`` gives the text measures as columns (``once`` keeps a later filter from computing them again), a table of :class:`Threshold` rows
says which ratios of them are allowed, and ``judge`` compiles that table into a
single ``select``: no user function, no shuffle, no second pass.

Measures: words (runs of characters other than space and ``\\t\\n\\v\\f\\r``), code points in words,
symbols ``#*$%&|<>``, lines equal to an earlier line, words within 8-word windows
that occur more than once in the text, stop words, capitals, exclamation marks, lines
that start with a bullet or end with an ellipsis.

Results for odd rows: null text counts as empty text; it has no word and fails the
base rule. Ratios over zero words or lines count as 0. Texts are measured whole,
however long, and no text fails for its length alone. Repeated rows are judged each; null ids are kept. Only the id, the
text and what ``keep`` names are read, so that other column names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeseries.functions.numeric import once
from changeseries.llm.columns import LOWER, SPACES, UPPER, character_count, let, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the be to of and that have with a in is it for on was as by this are from or an at not you he "
    "le la les de des et un une est que qui en dans pour par sur pas au aux plus ce il elle on du avec ou "
    "der die das und zu den von ist nicht mit sich ein eine auf für im dem auch es an als war so "
    "el los las y del se por con para su al lo como más pero sus o me si sin no"
).split()
STOP_WORD_LANGUAGES = ("en", "fr", "de", "es")
LONGEST_STOP_WORD = max(map(len, STOP_WORDS))


@dataclass(frozen=True)
class Threshold:
    """``numerator / denominator`` must lie in ``[low, high]`` where at least ``from_words`` words are present.

    With ``languages`` the rule is for texts in one of them, and for those whose language is not known.
    """

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0
    languages: tuple[str, ...] = ()


THRESHOLDS = (
    Threshold("words", "n_words", "one", MIN_WORDS),
    Threshold("word_length", "word_chars", "n_words", 2.0, 15.0),
    Threshold("symbols", "n_symbols", "n_words", high=0.1),
    Threshold("stop_words", "n_stop_words", "n_words", low=0.03, from_words=60, languages=STOP_WORD_LANGUAGES),
    Threshold("duplicate_lines", "n_dup_lines", "n_lines", high=0.5),
    Threshold("bullet_lines", "n_bullet_lines", "n_lines", high=0.9, from_words=60),
    Threshold("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=0.3),
    Threshold("capitals", "n_capitals", "word_chars", high=0.4),
    Threshold("exclamations", "n_exclamations", "n_words", high=0.25),
)

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_bullet_lines", "n_ellipsis_lines", "n_stop_words", "n_capitals", "n_exclamations",
)


def _windows(words: Column, joined) -> Column:
    count = F.size(words) - (WINDOW - 1)
    return F.when(count < 2, F.array()).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: joined(F.slice(words, i, WINDOW)))
    )


def repeated_words(words: Column) -> Column:
    """Number of words inside windows of eight that occur twice or more, first occurrences included.

    Texts whose window hashes all differ have none; only the others build and sort
    their windows, so a hash collision costs time, not correctness.
    """
    hashes = _windows(words, lambda w: F.xxhash64(w)).cast("array<bigint>")
    windows = _windows(words, lambda w: F.array_join(w, " ")).cast("array<string>")
    placed = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def starts(sorted_windows: Column) -> Column:
        neighbours = F.zip_with(
            F.slice(sorted_windows, 1, F.size(sorted_windows) - 1),
            F.slice(sorted_windows, 2, F.size(sorted_windows) - 1),
            lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
        )
        return F.array_sort(F.array_distinct(F.flatten(neighbours)))

    covered = F.aggregate(
        let(placed, starts),
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    all_differ = let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when(all_differ, F.lit(0)).otherwise(covered).cast("long")


def _measured(text: Column) -> Column:
    content = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> list[Column]:
        # Longer words need not be lower-cased to be ruled out.
        stops = F.filter(words, lambda w: (F.length(w) <= LONGEST_STOP_WORD) & F.translate(w, UPPER, LOWER).isin(STOP_WORDS))
        return [
            F.size(words).cast("long").alias("n_words"),
            repeated_words(words).alias("n_repeat_words"),
            F.size(stops).cast("long").alias("n_stop_words"),
        ]

    def of_lines(lines: Column) -> list[Column]:
        starting = F.filter(lines, lambda x: F.ltrim(x).rlike(r"^(?:[-*•‣▪]\s)"))
        ending = F.filter(lines, lambda x: F.rtrim(x).rlike(r"(?:\.\.\.|…)$"))
        return [
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(starting).cast("long").alias("n_bullet_lines"),
            F.size(ending).cast("long").alias("n_ellipsis_lines"),
        ]

    lines = F.filter(F.split(content, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return F.struct(
        let(words_of(text), lambda w: F.struct(*of_words(w))).alias("of_words"),
        let(lines, lambda x: F.struct(*of_lines(x))).alias("of_lines"),
        F.length(F.translate(content, SPACES, "")).cast("long").alias("word_chars"),
        character_count(content, SYMBOLS).alias("n_symbols"),
        character_count(content, UPPER).alias("n_capitals"),
        character_count(content, "!").alias("n_exclamations"),
    )


def measures(documents: DataFrame, text_column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and one long column per measure."""
    found = documents.select(*[F.col(c).alias(f"_{c}") for c in keep], once(_measured(F.col(text_column))).alias("m"))
    at = lambda c: f"m.{'of_words.' if c in ('n_words', 'n_repeat_words', 'n_stop_words') else 'of_lines.' if 'line' in c else ''}{c}"
    return found.select(*[F.col(f"_{c}").alias(c) for c in keep], *[F.col(at(c)).alias(c) for c in MEASURES])


def failed_rules(thresholds: tuple[Threshold, ...]) -> Column:
    """The names of the rules that a row of measures breaks, in the order of the table."""
    failing = []
    for rule in thresholds:
        below = F.col(rule.denominator) if rule.denominator != "one" else F.lit(1)
        ratio = F.when(below == 0, F.lit(0.0)).otherwise(F.col(rule.numerator) / below)
        breaks = F.lit(False)
        if rule.low is not None:
            breaks = breaks | (ratio < rule.low)
        if rule.high is not None:
            breaks = breaks | (ratio > rule.high)
        if rule.languages:
            breaks = breaks & F.coalesce(F.col("_language").isin(*rule.languages), F.lit(True))
        failing.append(F.when(breaks & (F.col("n_words") >= rule.from_words), F.lit(rule.name)))
    return F.array_compact(F.array(*failing)) if failing else F.array().cast("array<string>")


def judge(
    documents: DataFrame,
    text_column: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    thresholds: tuple[Threshold, ...] = THRESHOLDS,
    language_column: str | None = None,
) -> DataFrame:
    """``keep``, all measures, ``base_failed``, ``failed`` (names of broken rules) and ``kept``.

    ``language_column`` holds language codes; without it every text's language is unknown.
    """
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    language = F.lit(None).cast("string") if language_column is None else F.col(language_column)
    return (
        measures(documents.withColumn("_language", language), text_column, (*keep, "_language"))
        .withColumn("base_failed", base)
        .withColumn("failed", failed_rules(thresholds))
        .drop("_language")
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
    )
