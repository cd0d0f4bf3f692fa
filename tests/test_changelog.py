from datetime import datetime

import pytest
from pyspark.sql import functions as F

from changeseries.functions.timestamps import parse_timestamp_text, whole_seconds_between
from changeseries.sources.changelog import change_log, positional_keys, read_change_csv
from changeseries.sources.labels import read_label_csv

FORMS = {
    "2014-02-21": datetime(2014, 2, 21, 0, 0, 1),
    "2014-02-21T10:00:00+01:00": datetime(2014, 2, 21, 10),
    "2014-02-21T10:00:00-01:00": datetime(2014, 2, 21, 10),
    "2014-02-21T10:00:00Z": datetime(2014, 2, 21, 10),
    "2014-02-21T10:00:00.25+00:00": datetime(2014, 2, 21, 10, 0, 0, 250000),
    "2009-11-29 00:31:15.000000": datetime(2009, 11, 29, 0, 31, 15),
    "2009-11-29 00:31:15.5": datetime(2009, 11, 29, 0, 31, 15, 500000),
    "2009-11-29 00:31:15.": datetime(2009, 11, 29, 0, 31, 15),
    "2009-11-29 00:31:15": datetime(2009, 11, 29, 0, 31, 15),
    "2009-11-29 00:\n31:15.123456": datetime(2009, 11, 29, 0, 31, 15, 123456),
    "2009-11-29 00": None,
    "2009-11-29 00:31:15+02:00": None,
    "2009-13-29 00:31:15": None,
    "2009": None,
    "": None,
    "yesterday": None,
}


def test_timestamp_forms(spark):
    rows = spark.createDataFrame([(text,) for text in FORMS], "text STRING")
    parsed = rows.select("text", parse_timestamp_text(F.col("text")).alias("ts")).collect()
    assert {row["text"]: row["ts"] for row in parsed} == FORMS


def test_unreadable_time_raises_or_drops(spark):
    rows = spark.createDataFrame(
        [("e", "p", "v", "2014-02-21"), ("e", "p", "v", "soon"), ("e", "p", "v", None)],
        "a STRING, b STRING, c STRING, d STRING",
    )
    assert change_log(rows, on_error="drop").count() == 1
    with pytest.raises(Exception, match="unreadable change time"):
        change_log(rows).collect()
    with pytest.raises(ValueError):
        change_log(rows, on_error="ignore")


def test_only_times_and_text_are_times(spark):
    with pytest.raises(TypeError):
        change_log(spark.createDataFrame([("e", "p", "v", 1)], "a STRING, b STRING, c STRING, d INT"))
    with pytest.raises(ValueError):
        change_log(spark.createDataFrame([("e", "p")], "a STRING, b STRING"))


def test_missing_text_is_the_word_null(spark):
    rows = spark.createDataFrame(
        [(None, None, None, datetime(2020, 1, 1))], "a STRING, b STRING, c INT, d TIMESTAMP_NTZ"
    )
    assert change_log(rows).collect()[0][:3] == ("null", "null", "null")


def test_csv_drops_malformed_rows_also_when_counting(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        'e,p,v,2014-02-21\nb,p\ne,p,v,2014-02-21,extra\n"c ""x"" y",,"",2014-02-22 01:02:03.000000\n'
    )
    (tmp_path / "b.csv").write_text("f,p,v,2014-02-21T10:00:00+01:00\n")
    changes = read_change_csv(spark, str(tmp_path))
    assert changes.count() == 3
    assert sorted(row["entity"] for row in changes.select("entity").collect()) == ['c "x" y', "e", "f"]
    quoted = changes.filter(F.col("entity").startswith("c")).first()
    assert quoted[1:] == ("null", "null", datetime(2014, 2, 22, 1, 2, 3))
    assert read_change_csv(spark, str(tmp_path / "b.csv")).count() == 1


def test_csv_multiline_field(spark, tmp_path):
    (tmp_path / "a.csv").write_text('e,p,v,"2014-02-21 \n10:00:00.000000"\n')
    row = read_change_csv(spark, str(tmp_path), multiline=True).first()
    assert row["ts"] == datetime(2014, 2, 21, 10)


def test_list_filters_reach_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select(
        "o_orderpriority", "o_orderstatus", "o_totalprice", "o_orderdate"
    )
    kept = change_log(orders, entities=["1-URGENT"], properties=["F", "O"])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "In(o_orderstatus, [F,O])" in plan and "EqualTo(o_orderpriority,1-URGENT)" in plan
    expected = change_log(orders).filter("entity = '1-URGENT' AND property IN ('F', 'O')")
    assert kept.count() == expected.count() > 0


def test_list_filter_can_ask_for_null(spark):
    rows = spark.createDataFrame(
        [(None, "p", "v", "2014-02-21"), ("e", "p", "v", "2014-02-21")], "a STRING, b STRING, c STRING, d STRING"
    )
    assert [row["entity"] for row in change_log(rows, entities=["null"]).collect()] == ["null"]


def test_positional_keys(spark):
    rows = spark.createDataFrame(
        [(1, None, datetime(2020, 1, 1))], "a INT, b STRING, c TIMESTAMP_NTZ"
    )
    assert positional_keys(rows).collect()[0] == ("1", "null", datetime(2020, 1, 1))
    missing = spark.createDataFrame([(1, None)], "a INT, c TIMESTAMP_NTZ")
    with pytest.raises(Exception, match="without a readable time"):
        positional_keys(missing).collect()


def test_labels(spark, tmp_path):
    (tmp_path / "l.csv").write_text("Berlin,infobox settlement,9\nBerlin,Infobox Film,9\nX,infobox film,1\n")
    labels = read_label_csv(spark, str(tmp_path))
    assert sorted(map(tuple, labels.collect())) == [("Berlin", "infobox settlement"), ("X", "infobox film")]
    assert read_label_csv(spark, str(tmp_path), allowed=None).count() == 3


def test_whole_seconds_drop_fractions_first(spark):
    rows = spark.createDataFrame(
        [
            (datetime(2020, 1, 1, 0, 0, 0, 900000), datetime(2020, 1, 1, 0, 0, 1, 100000)),
            (datetime(1969, 12, 31, 23, 59, 59, 500000), datetime(1970, 1, 1)),
        ],
        "a TIMESTAMP_NTZ, b TIMESTAMP_NTZ",
    )
    seconds = rows.select(whole_seconds_between(rows["a"], rows["b"]).alias("s")).collect()
    assert [row["s"] for row in seconds] == [1, 1]
