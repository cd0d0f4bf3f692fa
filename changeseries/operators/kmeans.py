"""k-means over feature arrays, and the parts shared by both clusterings."""

from __future__ import annotations

import random
from collections.abc import Sequence
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeseries.functions.numeric import is_finite, once

CENTER_SCHEMA = "cluster INT, center ARRAY<DOUBLE>"


class Clusters(NamedTuple):
    """``members``: input columns plus ``assignedCluster``; ``centers``: (cluster, center)."""

    members: DataFrame
    centers: DataFrame
    model: Any = None


def center_table(spark: SparkSession, centers: Sequence[Sequence[float]]) -> DataFrame:
    """``(cluster, center)``; the values go over as Arrow arrays, not as objects."""
    values = [np.asarray(center, dtype=np.float64) for center in centers]
    ends = np.cumsum([0, *map(len, values)])
    lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate([*values, np.empty(0)])))
    table = pa.table({"cluster": pa.array(range(len(values)), pa.int32()), "center": lists})
    return spark.createDataFrame(table, CENTER_SCHEMA)


def non_finite_message() -> Column:
    return F.concat(F.lit("non-finite features of series "), F.array_join("name", ", ", "null"))


def finite_features(features: DataFrame, non_finite: str = "error") -> DataFrame:
    """Deal with NaN and infinite features, which no clustering can place.

    ``"error"`` fails the job that meets one, ``"drop"`` leaves the series out.
    """
    if non_finite == "drop":
        others = [name for name in features.columns if name != "features"]
        once_computed = features.select(*others, once(F.col("features")).alias("features"))
        return once_computed.filter(is_finite(F.col("features")))
    if non_finite != "error":
        raise ValueError("non_finite must be 'error' or 'drop'")
    return features.withColumn(
        "features",
        F.when(is_finite(F.col("features")), F.col("features")).otherwise(
            F.raise_error(non_finite_message()).cast("array<double>")
        ),
    )


def fit_kmeans(
    features: DataFrame, k: int = 10, max_iter: int = 100, seed: int | None = None
) -> Clusters:
    """MLlib k-means on ``(name, features)``; features come back as arrays.

    Hand in a stored table: the fit and the members both read it.
    """
    if k < 2:
        raise ValueError("k-means needs at least two clusters")
    kmeans = KMeans(
        featuresCol="vector",
        predictionCol="assignedCluster",
        k=k,
        maxIter=max_iter,
        seed=random.getrandbits(63) if seed is None else seed,
    )
    vectors = features.select(
        *[c for c in features.columns if c != "features"],
        array_to_vector("features").alias("vector"),
    )
    model = kmeans.fit(vectors)
    members = model.transform(vectors)
    members = members.select(
        *[c for c in features.columns if c != "features"],
        vector_to_array("vector").alias("features"),
        "assignedCluster",
    )
    centers = center_table(features.sparkSession, [c.tolist() for c in model.clusterCenters()])
    return Clusters(members, centers, model)
