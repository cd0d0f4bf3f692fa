import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from changeseries.llm import hard_negatives
from changeseries.llm.hard_negatives import Tree, mine, tiled, window_of

SCHEMA = "vec_id long, embedding array<double>, label int, id string, row int, tree string, score double"
LONG = (-(1 << 63), (1 << 63) - 1)


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, "y", 2.0) for i, v, label in rows], SCHEMA).repartition(3)


def usable(row):
    return row[2] is not None and row[1] is not None and all(x is not None and math.isfinite(x) for x in row[1])


def whole(vector, scale):
    return [min(max(math.floor(scale * x), LONG[0]), LONG[1]) for x in vector]


def product(a, b):
    return min(max(sum(x * y for x, y in zip(a, b)), LONG[0]), LONG[1])


def brute(rows, anchors, positives=5, negatives=5, scale=256, least=80, most=100):
    base = [(n, i, whole(v, scale), label) for n, (i, v, label) in enumerate(r for r in rows if usable(r))]
    out = []
    for n, i, vector, label in base:
        if i is None or i % anchors:
            continue
        others = [(-product(vector, v), j is None, j or 0, lab) for m, j, v, lab in base if m != n and len(v) == len(vector)]
        for below, no_id, j, _ in sorted(o for o in others if o[3] == label)[:positives]:
            fit = sorted(o[:3] for o in others if o[3] != label and least * -below <= 100 * -o[0] <= most * -below)
            out += [(i, None if no_id else j, r + 1, None if e[1] else e[2], -below, -e[0]) for r, e in enumerate(fit[:negatives])]
    return sorted(out, key=str)


def run(spark, rows, anchors, **options):
    found = mine(table(spark, rows), F.col("vec_id") % anchors == 0, **options).collect()
    return sorted(((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found), key=str)


def vectors(seed, n, dim=6, labels=4):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    rows = []
    for i in range(n):
        center = rng.choice(centers)
        rows.append((i * 2 - 40, [c + rng.gauss(0, 0.4) for c in center], rng.randrange(labels)))
        if rng.random() < 0.1:
            rows.append((10_000 - i, list(rows[rng.randrange(len(rows))][1]), rng.randrange(labels)))
    return rows


def test_brute_force(spark):
    rows = vectors(1, 400)
    assert run(spark, rows, 10) == brute(rows, 10)
    assert run(spark, rows, 20, positives=2, negatives=7, scale=9, least_percent=20, most_percent=150) == brute(rows, 20, 2, 7, 9, 20, 150)


def test_many_trees_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "pieces", lambda values, least, most: 5 if least == hard_negatives.TREE_VALUES else 4)
    rows = vectors(2, 300)
    assert run(spark, rows, 10) == brute(rows, 10)


def test_odd_rows(spark):
    rows = vectors(3, 60, dim=3, labels=2)
    rows += [(0, [1.0, 2.0, 3.0], 0), (0, [1.0, 2.0, 3.0], 0), (None, [1.0, 2.0, 3.0], 0), (None, [1.0, 2.0, 3.0], 1)]
    rows += [(500, None, 1), (600, [1.0, None, 2.0], 1), (700, [1.0, float("nan"), 2.0], 1), (800, [1.0, float("inf"), 2.0], 1), (900, [1.0, 2.0, 3.0], None)]
    rows += [(1000, [1.0, 2.0], 1), (1001, [1.0, 2.0], 1), (1002, [1.0, 2.1], 0), (1100, [], 1), (1101, [], 1), (1102, [], 0), (1200, [0.0, 0.0, 0.0], 1)]
    rows += [(1300, [0.1] * 5_000, 1), (1301, [0.1] * 5_000, 1), (1302, [0.1] * 5_000, 0), (1400, [-5.0, 0.0, 0.0, 0.0], 1), (1401, [5.0, 0.0, 0.0, 0.0], 1)]
    assert run(spark, rows, 100) == brute(rows, 100)
    assert run(spark, [], 100) == []
    assert run(spark, [(100, [1.0], 1)], 100) == []


def test_large_numbers(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([1e300, -1e300, 3e15, 1.0, 2.0**62, 7e8]), rng.uniform(-9e15, 9e15)], i % 2) for i in range(40)]
    assert run(spark, rows, 10) == brute(rows, 10)


def test_ties_and_copies(spark):
    rows = [(i, [0.5, 0.25], i % 3) for i in range(700)]
    assert run(spark, rows, 100) == brute(rows, 100)


@pytest.mark.parametrize("n", [0, 1, 128, 129, 5_000])
def test_leaves_hold_every_row_once(n):
    keys = np.random.default_rng(n).integers(0, 50, (n, 3))
    leaves = tiled(keys, 128)
    assert sorted(np.concatenate(leaves).tolist() if leaves else []) == list(range(n))
    assert all(len(leaf) <= 128 for leaf in leaves) and len(leaves) <= 2 * n / 128 + 2


def test_boxes_bound_the_scores_and_prune():
    rng = np.random.default_rng(5)
    values = (rng.normal(0, 1, (20, 4))[rng.integers(0, 20, 20_000)] * 1000 + rng.normal(0, 20, (20_000, 4))).astype(np.int64)
    labels = rng.integers(0, 3, 20_000)
    numbers = np.arange(20_000)
    tree = Tree.from_bytes(Tree.to_bytes(numbers, np.zeros(20_000, bool), labels, numbers, values))
    facing = tree.facing(values[:50])
    scores = values[:50] @ tree.values.astype(np.int64).T
    for node, (first, end) in enumerate(zip(tree.starts, tree.starts[1:])):
        assert (facing.least[:, node] <= scores[:, first:end].min(axis=1)).all()
        assert (facing.most[:, node] >= scores[:, first:end].max(axis=1)).all()
    for number in range(50):
        facing.positives(number, int(labels[number]), number, 5)
    assert facing.opened < 0.2 * 50 * (len(tree.starts) - 1)


def test_windows():
    for score in (-7, 0, 1, 99, 100, 10**20):
        low, high = window_of(score, 80, 100)
        assert all((80 * score <= 100 * n <= 100 * score) == (low <= n <= high) for n in (low - 1, low, high, high + 1))
