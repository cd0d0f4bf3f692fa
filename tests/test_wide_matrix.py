"""Matrices written from their cells, also wider than a pivot can be."""

import csv
from pathlib import Path

from pyspark.sql import functions as F

from changeseries.operators import matrix
from changeseries.sinks.lines import write_matrix


def read(path):
    """Header and rows of all part files; each file has the header."""
    tables = [list(csv.reader(file.open(newline=""))) for file in sorted(Path(path).glob("part-*")) if file.stat().st_size]
    assert all(table[0] == tables[0][0] for table in tables)
    return tables[0][0], [row for table in tables for row in table[1:]]


def test_cells_and_pivot_agree(spark, tmp_path):
    log = spark.createDataFrame([(f"e{i % 7}", f"p{i * i % 11:02}", "v") for i in range(60)], "entity string, property string, ts string")
    cells = matrix.pair_counts(log).select("entity", "property", "n")
    write_matrix(matrix.pivot_matrix(cells, "n"), str(tmp_path / "wide"), single_file=True)
    for single in (True, False):
        write_matrix(cells, str(tmp_path / f"cells-{single}"), single_file=single, value="n")
        assert read(tmp_path / f"cells-{single}") == read(tmp_path / "wide")


def test_fifteen_thousand_properties(spark, tmp_path):
    cells = spark.range(60_000).select(
        F.concat(F.lit("e"), (F.col("id") % 5).cast("string")).alias("entity"),
        F.format_string("p%05d", (F.col("id") * 7 % 15_000)).alias("property"),
    ).groupBy("entity", "property").agg(F.count("*").alias("n"))
    path = tmp_path / "matrix"
    write_matrix(cells, str(path), value="n", row_label="Entity")
    header, rows = read(path)
    assert header == ["Entity", *[f"p{i:05}" for i in range(15_000)]]
    assert [row[0] for row in rows] == [f"e{i}" for i in range(5)]
    expected = {(r.entity, r.property): r.n for r in cells.collect()}
    for row in rows:
        assert len(row) == 15_001
        assert all(int(n) == expected.get((row[0], name), 0) for name, n in zip(header[1:], row[1:]))


def test_odd_names_and_values(spark, tmp_path):
    rows = [('a "x", y', "p,1", 1.5), ("line\nbreak", 'q"', None), ("plain", "p,1", -2.0)]
    cells = spark.createDataFrame(rows, "entity string, property string, share double")
    write_matrix(cells, str(tmp_path / "odd"), single_file=True, value="share")
    assert read(tmp_path / "odd") == (["Settlement", "p,1", 'q"'], [['a "x", y', "1.5", "0"], ["line\nbreak", "0", "0"], ["plain", "-2.0", "0"]])
    write_matrix(cells.where("false"), str(tmp_path / "empty"), value="share")
    assert not [f for f in (tmp_path / "empty").glob("part-*") if f.stat().st_size]
