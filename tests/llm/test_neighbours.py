import numpy as np
import pytest
from pyspark.sql import functions as F

from changeseries.llm import neighbours
from changeseries.llm.queries import op7_nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, id string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x", "y") for i, v in rows], SCHEMA).repartition(3)


def run(spark, rows, k=20, every=20):
    got = neighbours.nearest(table(spark, rows), F.col("id") % every == 0, k=k).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def brute(rows, k=20, every=20):
    kept = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and len(v) and None not in v]
    kept = [(i, v) for i, v in kept if np.isfinite(v).all() and (v != 0).any()]
    out = {}
    for i, v in kept:
        if i % every == 0:
            ranked = sorted((-float(np.cumsum(v * w)[-1]), j) for j, w in kept if j != i and len(w) == len(v))
            out[i] = [(r, j, -s) for r, (s, j) in enumerate(ranked[:k], 1)]
    return {i: found for i, found in out.items() if found}


def test_few_vectors_are_found_exactly(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8) * rng.choice([0.1, 1, 5])) for i in range(90)]
    assert run(spark, rows, k=100) == brute(rows, k=100)


def test_odd_rows(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(20, same), (40, same), (7, same), (3, same), (60, None), (80, []), (100, [0, 0, 0]), (120, [1, None, 2]), (140, [1, float("nan"), 2]), (160, [float("inf"), 1, 2])]
    rows += [(None, same), (180, [1, 2]), (5, [2, 1]), (200, [-1, -2, -3]), (220, [9]), (9, [0.5, 0, 0])]
    assert run(spark, rows, k=3) == brute(rows, k=3)
    assert run(spark, []) == {} and run(spark, [(20, same)]) == {} and run(spark, [(21, same), (22, same)]) == {}


def test_repeated_rows_are_found_and_asked_once(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [1.0, 0.1]), (2, [0.5, 0.0])]
    assert [f[1] for f in run(spark, rows)[20]] == [1, 1, 2]


def test_many_equal_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 1.0, 0.0, 0.0]) for i in range(600)] + [(i, rng.normal(size=4)) for i in range(600, 700)]
    got, want = run(spark, rows, k=5), brute(rows, k=5)
    assert {q: f for q, f in got.items() if q < 600} == {q: f for q, f in want.items() if q < 600}


@pytest.mark.parametrize("cell", [20_000, 150])
def test_recall_on_scattered_vectors(spark, monkeypatch, cell):
    monkeypatch.setattr(neighbours, "CELL_VECTORS", cell)
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(30, 24))
    rows = [(i, centers[i % 30] + rng.normal(size=24) * 0.7) for i in range(3_000)]
    got, want = run(spark, rows), brute(rows)
    assert got.keys() == want.keys() and all(len(f) == 20 for f in got.values())
    hits = sum(len({f[1] for f in got[q]} & {f[1] for f in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9


def test_recall_of_the_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want, got = brute(rows), {}
    for r in op7_nearest_neighbours(spark, folder).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & {f[1] for f in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_perturbations_come_by_cost_and_move_no_projection_twice():
    rows = neighbours.perturbations(4, 200)
    assert (rows[0] == 0).all() and len({r.tobytes() for r in rows}) == len(rows) == 81
    assert all(r[i] + r[7 - i] < 2 for r in rows for i in range(4))
