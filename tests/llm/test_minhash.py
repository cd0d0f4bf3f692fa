import random

import numpy as np
import pytest
from helpers import documents, words

from changeseries.llm import components as stars
from changeseries.llm import minhash
from changeseries.llm.components import components
from changeseries.llm.wordhash import Powers


def shingle_set(text, size=5):
    found = [w.lower() for w in words(text)]
    return {tuple(found[i : i + size]) for i in range(max(len(found) - size + 1, 1))} if found else set()


def brute(rows, percent):
    sets = [shingle_set(r[1]) for r in rows]
    label = {r[0]: r[0] for r in rows if r[0] is not None}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    named = [i for i, r in enumerate(rows) if r[0] is not None]
    for i in named:
        for j in named:
            common = len(sets[i] & sets[j])
            if i < j and common and 100 * common >= percent * len(sets[i] | sets[j]):
                a, b = root(rows[i][0]), root(rows[j][0])
                label[max(a, b)] = min(a, b)
    return sorted(
        (str(r[0]), len(s), None if r[0] is None else root(r[0]), r[0] is None or root(r[0]) == r[0]) for r, s in zip(rows, sets)
    )


def run(spark, rows, percent=85):
    return run_table(documents(spark, rows), percent)


def run_table(table, percent=85):
    got = minhash.near_duplicates(table, percent=percent).collect()
    return sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in got)


def near_copies(seed, bases=12, copies=14):
    rng = random.Random(seed)
    rows, used = [], rng.sample(range(5_000), bases * copies + 60)
    for base in range(bases):
        text = [f"b{base}w{i}" for i in range(rng.choice([6, 20, 60, 150, 400]))]
        for _ in range(copies):
            changed = list(text)
            for _ in range(rng.randrange(4)):
                changed[rng.randrange(len(changed))] = f"x{rng.randrange(10**6)}"
            rows.append((used.pop(), " ".join(w.upper() if rng.random() < 0.1 else w for w in changed)))
    return rows + [(used.pop(), " ".join(f"u{rng.randrange(50)}" for _ in range(rng.randrange(40)))) for _ in range(60)]


@pytest.mark.parametrize("percent", [85, 80, 50])
def test_brute_force(spark, percent):
    rows = near_copies(11)
    assert run(spark, rows, percent) == brute(rows, percent)


@pytest.mark.parametrize("bound, value", [("BLOCK_MEMBERS", 7), ("BLOCK_BYTES", 4_000)])
def test_links_that_pairing_with_the_smallest_misses(spark, monkeypatch, bound, value):
    """A large group around no common document, in blocks of a few members or bytes."""
    monkeypatch.setattr(minhash, bound, value)
    monkeypatch.setattr(minhash, "INCIDENCE_COLUMNS", 16)
    rng = random.Random(12)
    text = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        changed = list(text)
        for place in rng.sample(range(120), rng.choice([1, 2, 3, 4])):
            changed[place] = f"x{i}"
        rows.append((i, " ".join(changed)))
    assert run(spark, rows) == brute(rows, 85)


def test_odd_rows(spark):
    rows = [(None, "same words in this text here"), (4, "Same words in this text here"), (9, "same WORDS in this text here"), (None, None), (1, None), (2, ""), (3, " \t")]
    rows += [(20, "short one"), (21, "SHORT one"), (22, "one short"), (23, "short"), (30, "Ä b c d e"), (31, "ä b c d e"), (40, "long word " * 30_000), (41, "long word " * 30_000)]
    rows += [(9, "same WORDS in this text here"), (9, "same WORDS in this text here")]
    assert run(spark, rows) == brute(rows, 85)
    assert run(spark, []) == []


def test_many_exact_copies(spark):
    rows = [(i, "the very same text in many documents of this table") for i in range(500)] + [(i, f"another text {i} " * 8) for i in range(500, 600)]
    assert run(spark, rows) == brute(rows, 85)


def test_estimate_is_close():
    rng, powers = random.Random(13), Powers()
    for share in (0.5, 0.8, 0.9):
        common = [f"c{i}" for i in range(int(3000 * share))]
        texts = [" ".join(common + [f"{side}{rng.random()}" for _ in range((3000 - len(common)) // 2)]).encode() for side in "ab"]
        found, counts = minhash.shingles(texts, 1, powers)
        sketches = minhash.registers(found, counts)
        similar, used = minhash.estimates(sketches[:1], sketches[1:])
        assert used[0] > 250 and abs(similar[0] - share) < 0.12


def test_band_width_keeps_the_recall():
    for percent in (50, 80, 85, 95):
        width = minhash.band_width(percent)
        assert (1 - (percent / 100) ** width) ** (minhash.REGISTERS // width) <= minhash.MISS_PROBABILITY


def test_borrowed_registers_follow_the_similarity():
    rng = np.random.default_rng(14)
    full = rng.integers(0, 2**63, 24, np.uint64) * np.uint64(2) + np.uint64(1)
    a = minhash.registers(np.sort(full), np.array([24]))
    b = minhash.registers(np.sort(full[:18]), np.array([18]))
    assert (minhash.densified(a) > 0).all() and (minhash.densified(a) == minhash.densified(a.copy())).all()
    assert 0.5 < (minhash.densified(a) == minhash.densified(b)).mean() < 0.95
    assert (minhash.densified(np.zeros((2, 256), np.uint16)) == 0).all()


def test_components(spark):
    chain = [(i + 1, i) for i in range(40)]
    star = [(100, i) for i in range(101, 160)]
    edges = [*chain, *star, (7, 7), (300, 200), (200, 300), (200, 250)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 160)}, 250: 200, 300: 200}
    assert components(spark.createDataFrame([], "x long, y long")).collect() == []


def test_stars_need_no_round(spark, monkeypatch):
    """Links that already hang at the smallest of their component are not contracted to find that out."""
    monkeypatch.setattr(stars, "_small_star", lambda edges: pytest.fail("a round"))
    edges = [(i, 3) for i in range(4, 30)] + [(3, 40), (41, 3), (41, 3), (60, 50), (60, 60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {**{i: 3 for i in [*range(4, 30), 40, 41]}, 60: 50}


def test_few_steps_shuffle(spark):
    """A large group of near copies over many shuffle partitions: tasks for each partition stay few."""
    partitions, rng = 60, random.Random(16)
    rows = near_copies(15, bases=3)
    text = [f"w{i}" for i in range(100)]
    rows += [(10_000 + i, " ".join(f"x{i}" if k in rng.sample(range(100), 3) else w for k, w in enumerate(text))) for i in range(60)]
    held = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.openCostInBytes": "64k"}
    before, context = {k: spark.conf.get(k) for k in held}, spark.sparkContext
    table = documents(spark, rows)
    try:
        for key, value in held.items():
            spark.conf.set(key, value)
        context.setJobGroup("near copies", "")
        assert run_table(table) == brute(rows, 85)
        context.setJobGroup("other", "")
        tracker = context.statusTracker()
        stages = {s for job in tracker.getJobIdsForGroup("near copies") for s in tracker.getJobInfo(job).stageIds}
        tasks = sum(info.numCompletedTasks for info in map(tracker.getStageInfo, stages) if info)  # none for stages that were not run
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for key, value in before.items():
            spark.conf.set(key, value)
    assert 10 * partitions < tasks < 45 * partitions, tasks / partitions
