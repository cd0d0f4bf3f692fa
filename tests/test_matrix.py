from datetime import datetime, timedelta

from changeseries.operators import matrix

T0 = datetime(2020, 1, 1)


def log_of(spark, rows):
    return spark.createDataFrame(
        [(e, p, "v", T0 + timedelta(seconds=s)) for e, p, s in rows],
        "entity STRING, property STRING, value STRING, ts TIMESTAMP_NTZ",
    )


ROWS = [
    ("Rome", "name", 0), ("Rome", "name", 10), ("Rome", "area", 0.9), ("Rome", "area", 4.1),
    ("Berlin", "name", 3), ("Berlin", "area", 2), ("Berlin", "mayor", 1), ("Oslo", "name", 1),
]


def test_counts(spark):
    log = log_of(spark, ROWS)
    assert {tuple(r)[:3] for r in matrix.pair_counts(log, ["area"]).collect()} == {("Rome", "area", 2), ("Berlin", "area", 1)}
    assert {tuple(r) for r in matrix.property_counts(log).collect()} == {("name", 4), ("area", 3), ("mayor", 1)}
    assert {tuple(r) for r in matrix.entity_counts(log, ["name", "area"]).collect()} == {("Rome", 4), ("Berlin", 2), ("Oslo", 1)}
    assert matrix.total_count(log).first()["n"] == 8
    assert {tuple(r) for r in matrix.lifespans(log, ["name", "area"]).collect()} == {
        ("Rome", "name", 10), ("Rome", "area", 4), ("Berlin", "name", 0), ("Berlin", "area", 0), ("Oslo", "name", 0)
    }


def test_complete_case(spark):
    log = log_of(spark, ROWS)
    cells = matrix.complete_case_cells(log, ["Rome", "Berlin"])
    assert {tuple(r) for r in cells.collect()} == {
        ("Rome", "name", 2), ("Berlin", "name", 1), ("Rome", "area", 2), ("Berlin", "area", 1)
    }
    assert {r["property"] for r in matrix.complete_case_cells(log, ["Rome", "Berlin"], top=1).collect()} == {"area"}
    wide = matrix.complete_case_matrix(log, ["Rome", "Berlin"])
    assert wide.columns == ["Settlement", "area", "name"]
    assert [tuple(r) for r in wide.collect()] == [("Berlin", 1, 1), ("Rome", 2, 2)]
    assert matrix.complete_case_matrix(log, ["Rome", "Paris"]).collect() == []


def test_shares_and_rates(spark):
    log = log_of(spark, ROWS)
    shares = {tuple(r)[:2]: r["share"] for r in matrix.property_share_cells(log, ["name", "mayor"]).collect()}
    assert shares == {("Rome", "name"): 0.5, ("Berlin", "name"): 0.25, ("Oslo", "name"): 0.25, ("Berlin", "mayor"): 1.0}
    assert len(matrix.property_share_cells(log).collect()) == 6
    wide = matrix.pivot_matrix(matrix.lifespan_rate_cells(log), "rate", fill=0.0)
    assert wide.columns == ["Settlement", "area", "mayor", "name"]
    infinity = float("inf")
    assert [tuple(r) for r in wide.collect()] == [
        ("Berlin", infinity, infinity, infinity), ("Oslo", 0.0, 0.0, infinity), ("Rome", 0.5, 0.0, 0.2)
    ]


def test_share_totals_reuse_the_counts(spark):
    # The totals are added up from the same shuffled counts: the log is read once.
    from changeseries.plans.catalog import activity

    shares = matrix.property_share_cells(activity(spark, "/root/testdata/sf0.001"))
    shares.collect()
    assert "ReusedExchange" in shares._jdf.queryExecution().executedPlan().toString()
