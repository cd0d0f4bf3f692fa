import hashlib
import random
from fractions import Fraction

import pytest
from helpers import documents, words

from changeseries.llm import mixing


def brute(rows, weights=(1, 2, 3), epochs=3, seed="mix"):
    """One queue for all: serve by virtual finish time until the budget is spent."""
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    size = {s: sum(len(words(r[1])) for r in rows if r[2] == s) for s in sources}
    budget, left, full = sum(size.values()), set(sources), set()
    while True:
        rest = budget - sum(epochs * size[s] for s in full)
        level = Fraction(rest, sum(weight[s] for s in left)) if left else 0
        over = {s for s in left if level * weight[s] > epochs * size[s]}
        if not over:
            break
        left, full = left - over, full | over
    target = {s: float(epochs * size[s] if s in full else level * weight[s]) for s in sources}
    entries = []
    for s in sources:
        queue = sorted((hashlib.md5(f"{seed}:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), len(words(r[1])), i) for i, r in enumerate(rows) if r[2] == s)
        before = 0
        for hashed, n, i in queue:
            before += n
            entries += [((e * size[s] + before) / weight[s], hashed, n, i) for e in range(epochs) if n]
    taken, spent = [0] * len(rows), 0
    for _, _, n, i in sorted(entries):
        spent += n
        if spent - n / 2 > budget:
            break
        taken[i] += n
    return sorted((str(r[0]), len(words(r[1])), size[r[2]], pytest.approx(target[r[2]]), t) for r, t in zip(rows, taken))


def run(spark, rows, **options):
    got = mixing.mix(documents(spark, rows), **options).collect()
    return sorted((str(r.doc_id), r.size, r.source_size, r.target, r.taken) for r in got)


def corpus(seed, shares, n=400):
    rng = random.Random(seed)
    names = list(shares)
    return [(i, "w " * rng.choice([0, 1, 5, 40, 200]), rng.choices(names, [shares[s] for s in names])[0]) for i in range(n)]


@pytest.mark.parametrize(
    "shares",
    [{"a": 1, "b": 1, "c": 1}, {"a": 30, "b": 1, "c": 1, None: 1}, {"only": 1}, {"é": 5, "z": 1, "A": 100, "": 1, "b": 2, "c": 2, "d": 2}],
)
def test_brute_force(spark, shares, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE_DOCUMENTS", 30)
    rows = corpus(8, shares)
    got = run(spark, rows)
    assert got == brute(rows)
    assert run(spark, rows) == got


def test_taken_words_come_near_the_targets(spark):
    rows = corpus(9, {"a": 30, "b": 3, "c": 1}, 900)
    got = mixing.mix(documents(spark, rows)).collect()
    for source in "abc":
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 200
        assert all(r.taken <= 3 * r.size for r in own)


def test_odd_rows(spark):
    rows = [(None, "a b", "s"), (None, None, None), (1, "", "s"), (2, "x " * 50_000, "s"), (3, "a b c", None), (3, "a b c", None)]
    got = run(spark, rows)
    assert [g[:4] for g in got] == [b[:4] for b in brute(rows)]
    assert all(g[4] % max(g[1], 1) == 0 and g[4] <= 3 * g[1] for g in got)
    assert run(spark, []) == []
    assert run(spark, [(1, None, "a"), (2, " ", None)]) == [("1", 0, 0, 0.0, 0), ("2", 0, 0, 0.0, 0)]


def test_native_plan(spark, capsys):
    mixing.mix(documents(spark, [(1, "a", "s")])).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan
