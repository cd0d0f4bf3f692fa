"""From a job description to clustered series."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeseries.functions.features import extract_features
from changeseries.functions.numeric import is_finite, once
from changeseries.functions.transforms import apply_transforms
from changeseries.functions.windows import TimeWindows
from changeseries.operators.dba import fit_dba_kmeans
from changeseries.operators.kmeans import Clusters, fit_kmeans, non_finite_message
from changeseries.operators.labels import join_labels
from changeseries.operators.series import ChangeFilter, Key, filter_changes, filter_values, series_groups, stored_times
from changeseries.plans.spec import JobSpec
from changeseries.storage import lasting_folder, scratch_path, stored
from changeseries.sinks import jdbc as jdbc_sink
from changeseries.sinks.lines import write_clusters
from changeseries.sources.changelog import positional_keys, read_change_csv
from changeseries.sources.jdbc import read_change_query, read_query
from changeseries.sources.labels import label_table, raw_label_csv


# How far a group of changes comes: left out by the group filter, its series by the series filter, as
# its features are not finite, or not at all.
LEFT_OUT, FILTERED, NON_FINITE, KEPT = STAGES = range(4)


class Features(NamedTuple):
    rows: DataFrame
    windows: TimeWindows


class Run(NamedTuple):
    """``metrics`` counts what went through the job: changes, series (all and filtered), feature
    rows, series removed as non-finite, labels (all and removed), joined rows. All are counts of stored rows."""

    features: DataFrame
    windows: TimeWindows
    members: DataFrame
    centers: DataFrame
    metrics: dict[str, int]


def read_source(spark: SparkSession, spec: JobSpec) -> DataFrame:
    """A change log, or for a pre-filtered query its keyed rows."""
    on_error = "raise" if spec.missing_time == "error" else "drop"
    if spec.file_source is not None:
        return read_change_csv(
            spark,
            spec.file_source,
            on_error=on_error,
            entities=spec.entities,
            properties=spec.properties,
        )
    if spec.query is None:
        raise ValueError("either a file or a database query must be given")
    if spec.query_prefiltered:
        return positional_keys(read_query(spark, spec.database, spec.query, spec.partitioning), on_error)
    return read_change_query(
        spark, spec.database, spec.query, spec.partitioning, on_error, spec.entities, spec.properties
    )


def stage_rows(
    changes: DataFrame,
    spec: JobSpec,
    keys: Sequence[Key] = ("entity",),
    change_filter: ChangeFilter | None = None,
    group_filter: Column | None = None,
    series_filter: Column | None = None,
) -> Features:
    """``(name, n, stage, features)`` of every group of changes, a lazy plan.

    ``stage`` says how far a group of ``n`` changes came: see ``STAGES``. Only the last stage has features.
    Missing bounds start a job here, which stores the keys and times of the changes.
    """
    changes = filter_changes(changes, change_filter)
    if spec.start is None or spec.end is None:
        changes, windows = stored_times(
            changes, keys, spec.granularity, spec.unit, group_filter, missing_time=spec.missing_time
        )
        keys = changes.columns[:-1]
    else:
        windows = TimeWindows(spec.start, spec.end, spec.granularity, spec.unit)
    groups = series_groups(
        changes,
        keys,
        windows,
        group_filter,
        spec.before_start,
        spec.after_end,
        missing_time=spec.missing_time,
    )
    y = F.when(F.col("kept"), apply_transforms(F.col("y"), list(spec.transformation), windows))
    if series_filter is None:
        series = groups.select("name", "n", "kept", y.alias("y"), F.col("kept").alias("passed"))
    else:
        passed = F.col("kept") & F.coalesce(series_filter, F.lit(False))
        series = groups.select("name", "n", "kept", once(y).alias("y")).withColumn("passed", passed)
    features = F.when(F.col("passed"), extract_features(F.col("y"), spec.feature_extraction))
    rows = series.select("name", "n", "kept", "passed", once(features).alias("features"))
    odd = F.lit(NON_FINITE) if spec.non_finite == "drop" else F.raise_error(non_finite_message()).cast("int")
    stage = (
        F.when(~F.col("kept"), F.lit(LEFT_OUT))
        .when(~F.col("passed"), F.lit(FILTERED))
        .when(~is_finite(F.col("features")), odd)
        .otherwise(F.lit(KEPT))
    )
    return Features(rows.select("name", "n", stage.alias("stage"), "features"), windows)


def series_features(
    changes: DataFrame,
    spec: JobSpec,
    keys: Sequence[Key] = ("entity",),
    change_filter: ChangeFilter | None = None,
    group_filter: Column | None = None,
    series_filter: Column | None = None,
) -> Features:
    """``(name, features)`` of a change log, as in ``stage_rows``."""
    rows, windows = stage_rows(changes, spec, keys, change_filter, group_filter, series_filter)
    return Features(rows.where(F.col("stage") == KEPT).select("name", "features"), windows)


def counted_features(rows: DataFrame, spread: bool = False) -> tuple[DataFrame, dict[str, int]]:
    """``(name, features)`` of the groups that came to the end, stored once, and how many came how far.

    The counts are read from the stored rows. A task that is repeated, or run twice, leaves its rows once, so what is counted is
    what the clustering reads. Of groups that did not come to the end, number of changes and stage
    are stored. With ``spread`` the rows are dealt out by their name.
    """
    spark = rows.sparkSession
    if spread:
        rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "name")
    done = F.col("stage") == KEPT
    path = scratch_path(spark, "features")
    kept = rows.select(F.when(done, F.col("name")).alias("name"), "n", "stage", F.when(done, F.col("features")).alias("features"))
    kept.write.parquet(path)
    there = spark.read.schema(kept.schema).parquet(path)
    found = {r["stage"]: r for r in there.groupBy("stage").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n")).collect()}
    at_least = lambda first: sum(r["groups"] for stage, r in found.items() if stage >= first)
    metrics = {
        "changes": sum(r["n"] for r in found.values()),
        "series": at_least(FILTERED),
        "filtered_series": at_least(NON_FINITE),
        "features": at_least(KEPT),
        "non_finite": at_least(NON_FINITE) - at_least(KEPT),
    }
    return there.where(done).select("name", "features"), metrics


def cluster(features: DataFrame, spec: JobSpec) -> Clusters:
    if spec.clustering_alg == "DBAKMeans":
        folder = f"{lasting_folder(features.sparkSession)}/rounds-{spec.config_identifier}" if spec.resume else None
        return fit_dba_kmeans(features, spec.k, spec.max_iter, spec.seed, resume=folder)
    return fit_kmeans(features, spec.k, spec.max_iter, spec.seed)


def run(
    spark: SparkSession,
    spec: JobSpec,
    keys: Sequence[Key] = ("entity",),
    change_filter: ChangeFilter | None = None,
    group_filter: Column | None = None,
    series_filter: Column | None = None,
    changes: DataFrame | None = None,
    labels: DataFrame | None = None,
    write: bool = True,
    single_file: bool = False,
) -> Run:
    """Run a whole job. ``changes`` and ``labels`` replace what the description names.

    A pre-filtered query brings its own keys; ``keys`` and ``group_filter`` do not
    apply to it. Features are stored once, as every clustering reads them often, and
    so are the members. What the description alone shows to be wrong fails before the first job.
    """
    if write and not spec.reads_database and spec.result_directory is None:
        raise ValueError("no result directory is given")
    all_labels = None
    if spec.add_ground_truth and labels is None:
        if spec.label_source is None:
            raise ValueError("ground truth is asked for, but no labels are given")
        all_labels = raw_label_csv(spark, spec.label_source)
        labels = label_table(all_labels, spec.label_templates)
    if changes is None:
        source = read_source(spark, spec)
    else:
        source = changes
        for column, values in (("entity", spec.entities), ("property", spec.properties)):
            source = source if values is None else filter_values(source, column, values)
    if changes is None and spec.reads_database and spec.query_prefiltered:
        keys, group_filter = source.columns[:-1], None
    staged, windows = stage_rows(source, spec, keys, change_filter, group_filter, series_filter)
    features, metrics = counted_features(staged, spread=spec.clustering_alg == "DBAKMeans")
    members, centers, _ = cluster(features, spec)
    if spec.add_ground_truth:
        members = join_labels(members, labels)
        metrics["labels"] = labels.count()
        metrics["removed_labels"] = 0 if all_labels is None else all_labels.count() - metrics["labels"]
    members = stored(members)
    metrics["members"] = members.count()
    if write:
        write_run(members, centers, spec, single_file)
    return Run(features, windows, members, centers, metrics)


def write_run(members: DataFrame, centers: DataFrame, spec: JobSpec, single_file: bool = False) -> None:
    if spec.reads_database:
        jdbc_sink.write_clusters(members, centers, spec.database, spec.config_identifier)
    elif spec.result_directory is None:
        raise ValueError("no result directory is given")
    else:
        write_clusters(members, centers, spec.result_directory, spec.config_identifier, single_file)
