"""Ground-truth labels: which template an entity belongs to."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The templates that count as ground truth.
TEMPLATES = (
    "infobox settlement",
    "infobox album",
    "infobox football biography",
    "infobox musical artist",
    "infobox film",
    "infobox person",
    "infobox single",
    "infobox company",
    "infobox actor",
    "infobox nrhp",
    "infobox french commune",
    "infobox book",
    "infobox television",
    "infobox military person",
    "infobox radio station",
    "infobox university",
    "infobox television episode",
    "infobox video game",
    "infobox officeholder",
    "infobox indian jurisdiction",
    "infobox uk place",
    "infobox school",
    "infobox road",
    "infobox writer",
    "infobox baseball biography",
    "infobox military unit",
    "infobox mountain",
    "infobox military conflict",
    "infobox german location",
    "infobox airport",
    "infobox ice hockey player",
    "infobox scientist",
    "infobox football club",
)


def label_table(rows: DataFrame, allowed: Iterable[str] | None = None) -> DataFrame:
    """First two columns as ``(entity, template)``, kept to the ``allowed`` templates."""
    labels = rows.select(
        rows[rows.columns[0]].cast("string").alias("entity"),
        rows[rows.columns[1]].cast("string").alias("template"),
    )
    return labels if allowed is None else labels.filter(F.col("template").isin(*allowed))


def raw_label_csv(spark: SparkSession, path: str, escape: str = '"') -> DataFrame:
    return label_table(spark.read.option("escape", escape).csv(path))


def read_label_csv(
    spark: SparkSession, path: str, allowed: Iterable[str] | None = TEMPLATES, escape: str = '"'
) -> DataFrame:
    return label_table(spark.read.option("escape", escape).csv(path), allowed)
