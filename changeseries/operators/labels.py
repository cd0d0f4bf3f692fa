"""Comparison with ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_labels(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with their ``trueCluster``; unlabelled series drop out.

    The first part of the name is matched with the label's entity, both in lower
    case; an entity with several labels appears once for each. No broadcast is
    forced: labels can be many, so Spark decides by their size, and splits an
    entity that has very many series if it has to shuffle.
    """
    labels = labels.select(
        F.lower("entity").alias("label_entity"), F.col("template").alias("trueCluster")
    )
    matches = F.lower(F.get("name", F.lit(0))) == F.col("label_entity")
    return members.join(labels, matches, "inner").drop("label_entity")
