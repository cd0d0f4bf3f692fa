"""Line-oriented text outputs of a clustering, and the matrix as CSV."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeseries.functions.numeric import NAN
from changeseries.functions.text import doubled_quotes, joined_name, joined_values, quoted
from changeseries.operators.matrix import ROW_LABEL


def padded_centers(centers: DataFrame) -> DataFrame:
    """Centers filled up with NaN to the length of the longest one."""
    longest = centers.agg(F.max(F.size("center"))).scalar()
    padding = F.array_repeat(F.lit(NAN), longest - F.size("center"))
    return centers.select("cluster", F.concat("center", padding).alias("center"))


def members_lines(members: DataFrame) -> DataFrame:
    """``"name","cluster"[,"true cluster"],v0,v1,...`` with quotes doubled in the name."""
    parts = [
        quoted(doubled_quotes(joined_name(F.col("name")))),
        quoted(F.col("assignedCluster").cast("string")),
    ]
    if "trueCluster" in members.columns:
        # A missing label is an empty field; left out, it would shift the values by one.
        parts.append(quoted(F.coalesce("trueCluster", F.lit(""))))
    parts.append(joined_values(F.col("features")))
    return members.select(F.concat_ws(",", *parts).alias("value"))


def centers_lines(centers: DataFrame) -> DataFrame:
    """One comma-joined line per center, in cluster order."""
    return (
        padded_centers(centers).orderBy("cluster").select(joined_values(F.col("center")).alias("value"))
    )


def centers_long(centers: DataFrame) -> DataFrame:
    """Center values as ``(index, value, cluster)``."""
    return padded_centers(centers).select(
        F.posexplode("center").alias("index", "value"), "cluster"
    )


def centers_long_lines(centers: DataFrame) -> DataFrame:
    return (
        centers_long(centers)
        .orderBy("cluster", "index")
        .select(
            F.concat_ws(
                ",", F.col("index").cast("string"), F.col("value").cast("string"), F.col("cluster").cast("string")
            ).alias("value")
        )
    )


def write_lines(lines: DataFrame, path: str, single_file: bool = False) -> None:
    """Text files under ``path``, which must not exist yet.

    ``single_file`` is for small results: it sends everything through one task.
    """
    (lines.coalesce(1) if single_file else lines).write.text(path)


def write_clusters(
    members: DataFrame,
    centers: DataFrame,
    result_directory: str,
    identifier: str,
    single_file: bool = False,
) -> None:
    """The three outputs under ``<result_directory><identifier>/``."""
    base = f"{result_directory}{identifier}"
    write_lines(members_lines(members), f"{base}/members.csv", single_file)
    # Centers are a handful of rows, whatever the number of series.
    write_lines(centers_lines(centers), f"{base}/centers.csv", single_file=True)
    write_lines(centers_long_lines(centers), f"{base}/clusterCentersTransposed.csv", single_file=True)


def csv_field(text: Column) -> Column:
    """A field as text; quoted, with quotes doubled, where it holds a comma, a quote or a line break."""
    special = F.contains(text, F.lit(",")) | F.contains(text, F.lit('"')) | F.contains(text, F.lit("\n")) | F.contains(text, F.lit("\r"))
    return F.when(special, quoted(doubled_quotes(text))).otherwise(text)


def matrix_lines(cells: DataFrame, value: str, row_label: str = ROW_LABEL) -> tuple[DataFrame, DataFrame]:
    """The header, one row, and the lines ``(entity, value)`` of a matrix of any width, entities in no order.

    ``cells`` are ``entity, property`` and the column ``value``, at most one row for each pair. Columns are numbered in the
    order of their names; an entity's cells, sorted by these numbers, are joined with as many zeros between
    them as columns lie between. Nothing is as wide as the matrix but its lines, and no column is one of Spark's.
    """
    names = cells.agg(F.sort_array(F.collect_set("property")).alias("names"))
    header = names.select(F.concat_ws(",", csv_field(F.lit(row_label)), F.transform("names", csv_field)).alias("value"))
    numbers = names.select(F.size("names").alias("width"), F.posexplode("names").alias("i", "property"))
    cell = F.struct(F.col("i"), F.coalesce(F.col(value).cast("string"), F.lit("0")).alias("text"))
    rows = cells.join(numbers, "property").groupBy("entity").agg(F.sort_array(F.collect_list(cell)).alias("cells"), F.max("width").alias("width"))

    def zeros(before: Column, after: Column) -> Column:
        return F.repeat(F.lit(",0"), after - before - 1)

    def number(at: Column) -> Column:
        return F.coalesce(F.get("cells", at)["i"], F.lit(-1))

    pieces = F.transform("cells", lambda one, at: F.concat(zeros(number(at - 1), one["i"]), F.lit(","), one["text"]))
    rest = zeros(number(F.size("cells") - 1), F.col("width"))
    return header, rows.select("entity", F.concat(csv_field(F.col("entity")), F.array_join(pieces, ""), rest).alias("value"))


def _write_cells(cells: DataFrame, value: str, path: str, row_label: str, single_file: bool) -> None:
    header, lines = matrix_lines(cells, value, row_label)
    first = header.first()["value"]  # as long as a line of the result
    shared = cells.sparkSession.sparkContext.broadcast(first)

    def below_header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for batch in batches:
            if batch.num_rows and not begun:
                begun = True
                yield pa.RecordBatch.from_arrays([pa.array([shared.value])], names=["value"])
            yield batch

    ordered = lines.orderBy("entity").select("value")
    ordered = ordered.coalesce(1) if single_file else ordered
    ordered.mapInArrow(below_header, "value string").write.text(path)


def write_matrix(
    matrix: DataFrame, path: str, single_file: bool = False, value: str | None = None, row_label: str = ROW_LABEL
) -> None:
    """CSV with a header in every file; a missing cell is ``0``. Ask for one file only if it is small.

    With ``value``, ``matrix`` is not wide but the cells ``entity, property`` and that column, for matrices wider than a
    table of Spark's.
    """
    if value is not None:
        _write_cells(matrix, value, path, row_label, single_file)
        return
    writer = (matrix.coalesce(1) if single_file else matrix).write
    writer.option("header", True).option("nullValue", "0").csv(path)
