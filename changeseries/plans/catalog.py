"""Registered queries: every operator on the provided tables, whole tables only.

Each takes ``(spark, folder)`` and returns a DataFrame. Series are given in long
form, one row per window, and computed doubles are rounded, so that results can
be compared with SQL row by row.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeseries.functions.features import extract_features
from changeseries.functions.text import joined_name
from changeseries.functions.windows import TimeWindows
from changeseries.operators import matrix, series
from changeseries.operators.dba import barycenter_partials, barycenter_positions, fit_dba_kmeans, moved_between, updated_centers
from changeseries.operators.kmeans import fit_kmeans
from changeseries.operators.labels import join_labels
from changeseries.operators.warping import assign_nearest, dtw_distance
from changeseries.plans.job import run, series_features
from changeseries.plans.spec import JobSpec
from changeseries.storage import scratch_path, stored
from changeseries.sinks.lines import centers_lines, centers_long, members_lines, write_lines, write_matrix
from changeseries.sources.changelog import change_log, positional_keys, read_change_csv
from changeseries.sources.labels import label_table, read_label_csv

JANUARY = (datetime(2024, 1, 1), datetime(2024, 1, 31))
YEARS = (datetime(1995, 1, 1), datetime(2001, 12, 1))
DIGITS = 6
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "MACHINERY")
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")

Query = Callable[[SparkSession, str], DataFrame]


# -- inputs ---------------------------------------------------------------------


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def activity(
    spark: SparkSession, folder: str, properties: tuple[str, ...] | None = None, where: Column | None = None
) -> DataFrame:
    """Events as a change log: user, event type, payload, time."""
    events = table(spark, folder, "events").select("user_id", "event_type", "props", "ts")
    return change_log(events, properties=properties, where=where)


def purchases(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as a change log: customer key, order status, price, order date."""
    return change_log(
        table(spark, folder, "orders").select("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    )


def priorities(spark: SparkSession, folder: str, entities: tuple[str, ...] | None = None) -> DataFrame:
    """Orders as a change log with few entities: priority, customer key, price, date."""
    return change_log(
        table(spark, folder, "orders").select("o_orderpriority", "o_custkey", "o_totalprice", "o_orderdate"),
        entities=entities,
    )


def shipments(spark: SparkSession, folder: str, properties: tuple[str, ...] | None = None) -> DataFrame:
    """Line items as a change log: supplier key, return flag, price, ship date."""
    return change_log(
        table(spark, folder, "lineitem").select("l_suppkey", "l_returnflag", "l_extendedprice", "l_shipdate"),
        properties=properties,
    )


def rounded(value: Column) -> Column:
    return F.round(value, DIGITS)


def long_form(rows: DataFrame, values: str = "y", digits: int | None = None) -> DataFrame:
    """``(name, i, value)``, one row per array element.

    The outer form of the generator is used on arrays that are never empty: for the
    inner one Spark adds a non-empty filter that would compute the array again.
    """
    rows = rows.select(joined_name(F.col("name")).alias("name"), F.posexplode_outer(values).alias("i", "value"))
    return rows if digits is None else rows.withColumn("value", F.round("value", digits))


def over_50() -> Column:
    return F.col("n") > 50


def daily(spark: SparkSession, folder: str) -> DataFrame:
    """Daily counts of the users with more than 50 events."""
    return series.build_series(
        activity(spark, folder), ["entity"], TimeWindows(*JANUARY, 1, "Days"), over_50()
    )


def daily_features(spark: SparkSession, folder: str) -> DataFrame:
    return daily(spark, folder).withColumnRenamed("y", "features")


# -- sources, filters, groups ---------------------------------------------------


def change_log_from_events(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return change_log(
        events.select("user_id", F.nullif("event_type", F.lit("error")).alias("event_type"), "props", "ts")
    )


def timestamp_parse_forms(spark: SparkSession, folder: str) -> DataFrame:
    moment = F.col("o_orderdate").cast("string")
    date, time = F.substring(moment, 1, 10), F.substring(moment, 12, 8)
    text = (
        F.when(F.col("o_orderstatus") == "F", date)
        .when(F.col("o_orderstatus") == "O", F.concat(date, F.lit("T"), time, F.lit("+01:00")))
        .otherwise(F.concat(date, F.lit(" "), time, F.lit(".500000")))
    )
    orders = table(spark, folder, "orders")
    return change_log(
        orders.select("o_orderkey", "o_orderstatus", F.lit("x").alias("value"), text.alias("ts"))
    )


def individual_filter(spark: SparkSession, folder: str) -> DataFrame:
    named = ("click", "error", "view")
    kept = series.filter_changes(activity(spark, folder, named, F.col("event_type") != "error"), F.col("property") != "error")
    kept = series.filter_values(kept, "property", named)
    return series.group_stats(kept, ["property"]).select(joined_name(F.col("name")).alias("name"), "n")


def group_counts_min50(spark: SparkSession, folder: str) -> DataFrame:
    groups = series.group_stats(activity(spark, folder), ["entity"], over_50())
    return groups.select(joined_name(F.col("name")).alias("name"), "n", "min_ts", "max_ts")


def distinct_entities(spark: SparkSession, folder: str) -> DataFrame:
    return series.distinct_entities(activity(spark, folder))


def time_bounds(spark: SparkSession, folder: str) -> DataFrame:
    return series.time_bounds(activity(spark, folder), ["entity"], over_50())


def run_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return series.run_metrics(activity(spark, folder), ["entity", "property"], F.col("n") > 12)


# -- series ---------------------------------------------------------------------


def daily_series(spark: SparkSession, folder: str) -> DataFrame:
    return long_form(daily(spark, folder))


def hourly_series(spark: SparkSession, folder: str) -> DataFrame:
    windows = TimeWindows(*JANUARY, 1, "Hours")
    return long_form(series.build_series(activity(spark, folder), ["property"], windows))


def series_clamp_before_start(spark: SparkSession, folder: str) -> DataFrame:
    windows = TimeWindows(datetime(2024, 1, 10), JANUARY[1], 2, "Days")
    return long_form(series.build_series(activity(spark, folder), ["entity", "property"], windows))


def series_drop_outside(spark: SparkSession, folder: str) -> DataFrame:
    windows = TimeWindows(datetime(2024, 1, 10), datetime(2024, 1, 20), 3, "Days")
    return long_form(
        series.build_series(
            activity(spark, folder), ["entity"], windows, before_start="drop", after_end="drop"
        )
    )


def monthly_series(spark: SparkSession, folder: str) -> DataFrame:
    windows = TimeWindows(*YEARS, 1, "Months")
    return long_form(series.build_series(shipments(spark, folder), ["entity"], windows))


def month_end_series(spark: SparkSession, folder: str) -> DataFrame:
    windows = TimeWindows(datetime(1996, 1, 31), YEARS[1], 2, "Months")
    return long_form(series.build_series(shipments(spark, folder), ["property"], windows))


def yearly_series(spark: SparkSession, folder: str) -> DataFrame:
    windows = TimeWindows(datetime(1996, 2, 29), YEARS[1], 1, "Years")
    return long_form(series.build_series(shipments(spark, folder), ["property"], windows))


def query_keys_series(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    rows = positional_keys(orders.select("o_orderstatus", "o_orderpriority", "o_orderdate"))
    return long_form(series.build_series(rows, rows.columns[:-1], TimeWindows(*YEARS, 7, "Days")))


def derived_bounds_series(spark: SparkSession, folder: str) -> DataFrame:
    return long_form(series.derived_series(purchases(spark, folder), ["entity"], F.col("n") > 9, 60, "Days")[0])


# -- transforms and features ----------------------------------------------------


def transformed(*transforms: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return long_form(series.transform_series(daily(spark, folder), transforms), digits=DIGITS)

    return query


def sixty_day_orders(spark: SparkSession, folder: str) -> tuple[DataFrame, TimeWindows]:
    windows = TimeWindows(*YEARS, 60, "Days")
    return series.build_series(purchases(spark, folder), ["entity"], windows), windows


def series_remove_leading_zero(spark: SparkSession, folder: str) -> DataFrame:
    rows, windows = sixty_day_orders(spark, folder)
    return long_form(series.transform_series(rows, ["RemoveLeadingZero"], windows))


def series_cutoff(spark: SparkSession, folder: str) -> DataFrame:
    rows, windows = sixty_day_orders(spark, folder)
    return long_form(series.transform_series(rows, ["cutoffAt"], windows))


def series_rlz_cutoff_normalize(spark: SparkSession, folder: str) -> DataFrame:
    rows, windows = sixty_day_orders(spark, folder)
    chain = ["RemoveLeadingZero", "cutoffAt", "Normalize"]
    busy = F.array_max("y") > F.array_min("y")
    rows = series.transform_series(rows, chain[:2], windows, busy)
    return long_form(series.transform_series(rows, chain[2:], windows), digits=DIGITS)


def series_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Series whose busiest day had at least six events, square-rooted."""
    return long_form(
        series.transform_series(daily(spark, folder), ["sqrt"], series_filter=F.array_max("y") >= F.sqrt(F.lit(6.0))),
        digits=DIGITS,
    )


def features(method: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        rows = daily(spark, folder).select("name", extract_features(F.col("y"), method).alias("features"))
        return long_form(rows, "features")

    return query


# -- matrices -------------------------------------------------------------------


def entity_property_counts(spark: SparkSession, folder: str) -> DataFrame:
    return matrix.pair_counts(activity(spark, folder))


def property_counts(spark: SparkSession, folder: str) -> DataFrame:
    return matrix.property_counts(activity(spark, folder, EVENT_TYPES[:4]))


def entity_counts(spark: SparkSession, folder: str) -> DataFrame:
    return matrix.entity_counts(activity(spark, folder, EVENT_TYPES[:4]))


def total_count(spark: SparkSession, folder: str) -> DataFrame:
    return matrix.total_count(activity(spark, folder), EVENT_TYPES[:4])


def property_lifespan(spark: SparkSession, folder: str) -> DataFrame:
    return matrix.lifespans(activity(spark, folder))


def complete_property_matrix_top10(spark: SparkSession, folder: str) -> DataFrame:
    return matrix.complete_case_cells(priorities(spark, folder, PRIORITIES), PRIORITIES)


def count_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return matrix.pivot_matrix(matrix.pair_counts(shipments(spark, folder)), "n", ["A", "N", "R"])


def property_share_matrix(spark: SparkSession, folder: str) -> DataFrame:
    cells = matrix.property_share_cells(activity(spark, folder, EVENT_TYPES[:4]), EVENT_TYPES[:4])
    wide = matrix.pivot_matrix(cells, "share", EVENT_TYPES[:4], fill=0.0)
    return wide.select("Settlement", *[F.round(name, 9).alias(name) for name in EVENT_TYPES[:4]])


def lifespan_rate_matrix(spark: SparkSession, folder: str) -> DataFrame:
    cells = matrix.lifespan_rate_cells(shipments(spark, folder, ("A", "N", "R")), ["A", "N", "R"])
    wide = matrix.pivot_matrix(cells, "rate", ["A", "N", "R"], fill=0.0)
    return wide.select("Settlement", *[F.round(F.col(name) * 1e6, DIGITS).alias(name) for name in "ANR"])


def lifespan_rate_cells(spark: SparkSession, folder: str) -> DataFrame:
    cells = matrix.lifespan_rate_cells(purchases(spark, folder))
    finite = F.abs(F.col("rate")) < float("inf")
    return cells.select(
        "entity", "property", (~finite).alias("instant"), F.when(finite, F.round(F.col("rate") * 1e6, DIGITS)).alias("rate")
    )


def missing_times_dropped(spark: SparkSession, folder: str) -> DataFrame:
    """Daily counts of all events, where errors have lost their times."""
    events = table(spark, folder, "events").select("user_id", "event_type", "props", F.when(F.col("event_type") != "error", F.col("ts")).alias("ts"))
    changes = change_log(events, on_error="drop")
    return long_form(series.build_series(changes, ["property"], TimeWindows(*JANUARY, 1, "Days")))


# -- clustering -----------------------------------------------------------------


def ground_truth_join(spark: SparkSession, folder: str) -> DataFrame:
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    # Joined on the customer key, both sides grow with the data: sizes decide the strategy.
    named = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    changes = change_log(named.select(F.upper("c_name"), "o_orderstatus", "o_totalprice", "o_orderdate"))
    rows = series.build_series(changes, ["entity"], TimeWindows(*YEARS, 1, "Years"))
    members = rows.select("name", F.col("y").alias("features"), F.lit(0).alias("assignedCluster"))
    labels = label_table(customer.select("c_name", "c_mktsegment"), SEGMENTS)
    return join_labels(members, labels).select(
        joined_name(F.col("name")).alias("name"), "trueCluster", F.posexplode_outer("features").alias("i", "value")
    )


def kmeans_two_scales(spark: SparkSession, folder: str) -> DataFrame:
    """Users and event types as series side by side: two clusters, far apart.

    Every series comes with the center it was assigned to, so that the result does
    not depend on how the clusters are numbered.
    """
    changes = activity(spark, folder)
    users, types = changes.select("entity", "ts"), changes.select(F.col("property").alias("entity"), "ts")
    rows = series.build_series(users.unionAll(types), ["entity"], TimeWindows(*JANUARY, 3, "Days"))
    clusters = fit_kmeans(stored(rows.withColumnRenamed("y", "features")), k=2, max_iter=20, seed=1)
    own = clusters.members.join(clusters.centers, F.col("assignedCluster") == F.col("cluster"))
    return long_form(own, "center", DIGITS)


def kmeans_members(spark: SparkSession, folder: str) -> DataFrame:
    clusters = fit_kmeans(stored(daily_features(spark, folder)), k=5, max_iter=20, seed=13)
    return clusters.members.select(joined_name(F.col("name")).alias("name"), "assignedCluster")


def dtw_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Warping distance between every user's click series and purchase series."""
    rows = series.build_series(
        activity(spark, folder, ("click", "purchase")), ["entity", "property"], TimeWindows(*JANUARY, 3, "Days")
    ).select(F.get("name", F.lit(0)).alias("entity"), F.get("name", F.lit(1)).alias("property"), "y")
    of = lambda kind: F.first(F.when(F.col("property") == kind, F.col("y")), ignorenulls=True).alias(kind)
    both = rows.groupBy("entity").agg(of("click"), of("purchase"))
    both = both.where("click IS NOT NULL AND purchase IS NOT NULL")
    return both.select("entity", dtw_distance("click", "purchase").alias("distance"))


def dtw_nearest_center(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest of four given vectors (those with the smallest ids) for every vector."""
    vectors = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))
    first = vectors.orderBy("vec_id").limit(4).collect()
    nearest = assign_nearest(vectors, [row["features"] for row in first], cost="cost")
    return nearest.select("vec_id", "assignedCluster", rounded(F.col("cost")).alias("cost"))


def first_series(rows: DataFrame, k: int) -> list[list[float]]:
    return [row["features"] for row in rows.orderBy("name").limit(k).collect()]


def dba_update(spark: SparkSession, folder: str) -> DataFrame:
    """Centers after one update, starting from the first three series by name."""
    rows = stored(daily_features(spark, folder), spread=True)
    clusters = fit_dba_kmeans(rows, max_iter=1, centers=first_series(rows, 3))
    return centers_long(clusters.centers).select("cluster", "index", rounded(F.col("value")).alias("value"))


def dba_two_updates(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters after two updates (one, if no series moves) from the first three series."""
    rows = stored(daily_features(spark, folder), spread=True)
    members = fit_dba_kmeans(rows, max_iter=2, centers=first_series(rows, 3)).members
    return members.select(joined_name(F.col("name")).alias("name"), "assignedCluster")


def barycenter_update(spark: SparkSession, folder: str) -> DataFrame:
    """Warped average of all vectors around the one with the smallest id."""
    vectors = table(spark, folder, "embeddings").select(
        F.array(F.col("vec_id").cast("string")).alias("name"), "vec_id",
        F.col("embedding").cast("array<double>").alias("features"),
    )
    center = vectors.orderBy("vec_id").limit(1).select("features").collect()[0]["features"]
    sums = barycenter_positions(barycenter_partials(vectors.select("name", "features"), [center]))
    return sums.select(
        F.col("position").alias("i"), rounded(F.col("total") / F.col("weight")).alias("value")
    )


def dba_kmeans_members(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored(daily_features(spark, folder), spread=True)
    members = fit_dba_kmeans(rows, k=5, max_iter=10, seed=13).members
    return members.select(joined_name(F.col("name")).alias("name"), "assignedCluster")


def dba_drawn_centers(spark: SparkSession, folder: str) -> DataFrame:
    """The five series drawn as initial centers."""
    clusters = fit_dba_kmeans(stored(daily_features(spark, folder), spread=True), k=5, max_iter=0, seed=13)
    return centers_long(clusters.centers)


def dba_assignment_changes(spark: SparkSession, folder: str) -> DataFrame:
    """How many series the first update moved to another cluster."""
    rows = stored(daily_features(spark, folder), spread=True)
    start = first_series(rows, 3)
    renewed, _, _ = updated_centers(rows, start)
    return moved_between(rows, start, renewed)


# -- sinks and whole jobs -------------------------------------------------------


def members_text(spark: SparkSession, folder: str) -> DataFrame:
    """Members of the clusters after one update from the first three series."""
    rows = stored(daily_features(spark, folder), spread=True)
    clusters = fit_dba_kmeans(rows, max_iter=1, centers=first_series(rows, 3))
    path = scratch_path(spark, "members")
    write_lines(members_lines(clusters.members), path)
    return spark.read.text(path)


def centers_text(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the centers after one update from the first three series, read back and rounded."""
    rows = stored(daily_features(spark, folder), spread=True)
    clusters = fit_dba_kmeans(rows, max_iter=1, centers=first_series(rows, 3))
    path = scratch_path(spark, "centers")
    write_lines(centers_lines(clusters.centers), path, single_file=True)
    lines = spark.read.text(path).select(F.monotonically_increasing_id().cast("int").alias("line"), "value")
    values = lines.select("line", F.posexplode(F.split("value", ",")).alias("i", "value"))
    return values.withColumn("value", rounded(F.col("value").cast("double")))


def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """All events as header-less CSV, each followed by two malformed lines, read back."""
    def cell(column: Column) -> Column:
        doubled = F.replace(column, F.lit('"'), F.lit('""'))
        return F.concat(F.lit('"'), doubled, F.lit('"'))

    events = table(spark, folder, "events")
    stamp = F.col("ts").cast("string")
    good = F.concat_ws(",", cell(F.col("user_id").cast("string")), cell("event_type"), cell("props"), cell(stamp))
    short = F.concat_ws(",", cell(F.col("user_id").cast("string")), cell("event_type"))
    long = F.concat_ws(",", good, F.lit("extra"))
    path = scratch_path(spark, "events-csv")
    write_lines(events.select(F.explode(F.array(good, short, long)).alias("value")), path)
    return read_change_csv(spark, path)


def label_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "labels-csv")
    customer = table(spark, folder, "customer")
    customer.select("c_name", "c_mktsegment", "c_nationkey").write.csv(path)
    return read_label_csv(spark, path, SEGMENTS)


def matrix_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "matrix-csv")
    write_matrix(count_matrix(spark, folder), path)
    names = "Settlement STRING, A STRING, N STRING, R STRING"
    return spark.read.schema(names).option("header", True).csv(path)


def complete_matrix_wide(spark: SparkSession, folder: str) -> DataFrame:
    """The wide top-10 matrix, read off column by column into cells."""
    wide = matrix.complete_case_matrix(priorities(spark, folder), PRIORITIES)
    return wide.unpivot("Settlement", wide.columns[1:], "property", "n")


def wide_matrix_csv(spark: SparkSession, folder: str) -> DataFrame:
    """A column for every user, written from cells; the lines of all files, the header once."""
    log = activity(spark, folder).select(F.col("property").alias("entity"), F.col("entity").alias("property"), "ts")
    path = scratch_path(spark, "wide-matrix")
    write_matrix(matrix.pair_counts(log), path, value="n")
    return spark.read.text(path).distinct()


SPEC = {
    "start": "2024-01-01 00:00:00.0",
    "end": "2024-01-31 00:00:00.0",
    "fileSource": "unused",
    "resultDirectory": "unused",
    "addGroundTruth": False,
    "configIdentifier": "daily",
    "granularity": 1,
    "unit": "Days",
    "transformation": ["Log", "Normalize"],
    "featureExtraction": "Raw",
    "clusteringAlg": "DBAKMeans",
    "DBAKMeans Parameters": {"k": 3, "maxIter": 2, "seed": 13},
}


def clustered_series(spark: SparkSession, folder: str) -> DataFrame:
    """A whole job from its description, with all hooks in use."""
    result = run(
        spark,
        JobSpec.from_dict(SPEC),
        keys=["entity"],
        change_filter=F.col("property") != "error",
        group_filter=over_50(),
        series_filter=F.get("y", F.lit(0)) < 2.5,
        changes=activity(spark, folder),
        write=False,
    )
    return result.members.select(
        joined_name(F.col("name")).alias("name"),
        "assignedCluster",
        F.posexplode("features").alias("i", "value"),
    ).select("name", "assignedCluster", "i", rounded(F.col("value")).alias("value"))


def spec_features_derived_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """A description without bounds and with statistics features."""
    config = {key: value for key, value in SPEC.items() if key not in ("start", "end")}
    spec = JobSpec.from_dict({**config, "transformation": [], "featureExtraction": "Statistics"})
    return long_form(series_features(activity(spark, folder), spec, ["entity", "property"]).rows, "features")


QUERIES: dict[str, Query] = {
    "change_log_from_events": change_log_from_events,
    "timestamp_parse_forms": timestamp_parse_forms,
    "individual_filter": individual_filter,
    "group_counts_min50": group_counts_min50,
    "distinct_entities": distinct_entities,
    "time_bounds": time_bounds,
    "run_metrics": run_metrics,
    "daily_series": daily_series,
    "hourly_series": hourly_series,
    "series_clamp_before_start": series_clamp_before_start,
    "series_drop_outside": series_drop_outside,
    "monthly_series": monthly_series,
    "month_end_series": month_end_series,
    "yearly_series": yearly_series,
    "query_keys_series": query_keys_series,
    "derived_bounds_series": derived_bounds_series,
    "series_normalize": transformed("Normalize"),
    "series_log": transformed("log"),
    "series_sqrt": transformed(" SQRT "),
    "series_log_normalize": transformed("Log", "None", "Normalize"),
    "series_remove_leading_zero": series_remove_leading_zero,
    "series_cutoff": series_cutoff,
    "series_rlz_cutoff_normalize": series_rlz_cutoff_normalize,
    "series_filter": series_filter,
    "features_statistics": features("Statistics"),
    "features_raw": features("Raw"),
    "entity_property_counts": entity_property_counts,
    "property_counts": property_counts,
    "entity_counts": entity_counts,
    "total_count": total_count,
    "property_lifespan": property_lifespan,
    "complete_property_matrix_top10": complete_property_matrix_top10,
    "complete_matrix_wide": complete_matrix_wide,
    "count_matrix": count_matrix,
    "property_share_matrix": property_share_matrix,
    "lifespan_rate_matrix": lifespan_rate_matrix,
    "lifespan_rate_cells": lifespan_rate_cells,
    "ground_truth_join": ground_truth_join,
    "kmeans_two_scales": kmeans_two_scales,
    "kmeans_members": kmeans_members,
    "dtw_pairs": dtw_pairs,
    "dtw_nearest_center": dtw_nearest_center,
    "dba_update": dba_update,
    "dba_two_updates": dba_two_updates,
    "barycenter_update": barycenter_update,
    "dba_kmeans_members": dba_kmeans_members,
    "dba_drawn_centers": dba_drawn_centers,
    "missing_times_dropped": missing_times_dropped,
    "dba_assignment_changes": dba_assignment_changes,
    "members_lines": members_text,
    "centers_lines": centers_text,
    "csv_round_trip": csv_round_trip,
    "label_csv": label_csv,
    "matrix_csv": matrix_csv,
    "wide_matrix_csv": wide_matrix_csv,
    "clustered_series": clustered_series,
    "spec_features_derived_bounds": spec_features_derived_bounds,
}
