"""The nearest center by bounds equals the one by full tables, cost for cost."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from changeseries.operators import warping


def by_full_tables(series, groups):
    costs = np.full((len(series), sum(len(at) for at, _ in groups)), np.inf)
    for at, centers in groups:
        costs[:, at] = warping.warping_costs(series, centers)
    costs[np.isnan(costs)] = np.inf
    best = costs.argmin(axis=1)
    cheapest = costs[np.arange(len(series)), best]
    return np.where(np.isfinite(cheapest), best, -1), cheapest


def same(series, centers):
    groups = warping.center_groups(centers)
    expected, found = by_full_tables(series, groups), warping.nearest(series, groups)
    return (expected[0] == found[0]).all() and (expected[1] == found[1]).all()


values = st.one_of(st.integers(-3, 3).map(float), st.sampled_from([0.1, 1e-9, 1e9, float("nan"), float("inf")]))


@settings(max_examples=150, deadline=None)
@given(
    st.integers(1, 7).flatmap(lambda n: st.lists(st.lists(values, min_size=n, max_size=n), min_size=1, max_size=9)),
    st.lists(st.lists(values, min_size=1, max_size=7), min_size=1, max_size=9),
)
def test_odd_values_and_ties(series, centers):
    with np.errstate(all="ignore"):
        assert same(np.array(series), centers)


@pytest.mark.parametrize("every", [1, 3, 24])
def test_long_series(monkeypatch, every):
    monkeypatch.setattr(warping, "GIVE_UP_EVERY", every)
    monkeypatch.setattr(warping, "BLOCK_ELEMENTS", 2_000)
    rng = np.random.default_rng(every)
    counts = rng.poisson(rng.gamma(0.5, 4, (300, 1)) * np.ones((1, 50))).astype(float)
    assert same(counts, [*counts[:20].tolist(), *counts[20:25, :30].tolist(), *counts[:3].tolist()])
    spread = (counts - counts.mean(axis=1, keepdims=True)) / np.maximum(counts.std(axis=1, keepdims=True), 1)
    assert same(spread, spread[:33].tolist())


def test_bounds_are_below_the_costs():
    rng = np.random.default_rng(2)
    for length, points in ((1, 1), (1, 5), (5, 1), (2, 2), (20, 33)):
        series, centers = rng.normal(size=(50, length)), rng.normal(size=(7, points))
        assert (warping.lower_bounds(series, centers) * (1 - warping.ROUNDING) <= warping.warping_costs(series, centers)).all()


def test_most_tables_of_scaled_counts_are_left_out():
    """33 centers, series of very different levels: two thirds of the tables are never begun."""
    rng = np.random.default_rng(3)
    level = np.exp(rng.normal(0, 1, (1500, 1)) + np.cumsum(rng.normal(0, 0.3, (1500, 85)), axis=1))
    counts = rng.poisson(level.clip(0, 200)).astype(float)
    tally = {}
    warping.nearest(counts, warping.center_groups(counts[:33].tolist()), tally)
    assert tally["pairs"] == 33 * 1500 and tally["begun"] < 0.35 * tally["pairs"]
